"""Seller files, robots files and pages as tables of documents, and their state transitions.

A file is bounded by what the fetcher accepts, so windows and lists per file stay small however
many files there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.catalogs import ADS_CONDITION_CODES, HEALTHY_CONFIG_STATUSES
from tidemark.functions import text as T
from tidemark.functions import urls as U
from tidemark.functions.shape import either
from tidemark.operators.ordered import DAY, latest_before
from tidemark.session import written

LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
# --- fixed values: seller file directives and bounds ------------------------------------------
DIRECTIVES = ("OWNERDOMAIN", "MANAGERDOMAIN", "CONTACT", "SUBDOMAIN", "INVENTORYPARTNERDOMAIN")
MAX_RECORDS = 100_000
AGENT = r"^(?:[-A-Za-z_]+|\*)$"


def _strip(value: Column) -> Column:
    """Without white space around; the value is a line or a part of one, so it holds no line break."""
    return F.btrim(value, F.lit(" \t\n\x0b\f\r"))


def file_lines(files: DataFrame) -> DataFrame:
    """(file_id, line_no, line): comments cut, trimmed, blank lines left out, numbers as in the file."""
    body = F.regexp_replace("text", "^﻿", "")
    rows = files.select("file_id", F.posexplode(F.split(body, LINE_BREAK)).alias("pos", "raw"))
    return rows.select("file_id", (F.col("pos") + 1).alias("line_no"), _strip(F.substring_index("raw", "#", 1)).alias("line")).where(
        F.col("line") != ""
    )


def ads_lines(files: DataFrame, international: bool = True) -> DataFrame:
    """Every meaningful line of a seller file as RECORD, DIRECTIVE or INVALID with its diagnostic."""
    lines = file_lines(files)
    name = F.upper(_strip(F.substring_index("line", "=", 1)))
    is_directive = F.contains("line", F.lit("=")) & name.isin(*DIRECTIVES)
    value = _strip(F.regexp_replace("line", r"^[^=]*=", ""))
    fields = F.transform(F.split("line", ","), _strip)
    parts = F.transform(F.split(value, ","), _strip)
    df = lines.select(
        "file_id", "line_no", F.when(is_directive, name).alias("directive"), F.when(is_directive, value).alias("directive_value"),
        F.when(is_directive, parts).alias("parts"), F.when(~is_directive, fields).alias("fields"),
    )
    asked = F.coalesce(
        F.when(F.col("directive") == "MANAGERDOMAIN", F.col("parts")[0]), F.when(F.col("directive").isNotNull(), F.col("directive_value")), F.col("fields")[0]
    )
    df = df.withColumn("domain", U.norm_domain(asked, international))
    at = lambda i: F.try_element_at("fields", F.lit(i))
    country = F.when((F.size("parts") == 2) & (F.col("parts")[1] != ""), F.upper(F.col("parts")[1]))
    df = (
        df.withColumn("account", at(2)).withColumn("relationship", F.upper(at(3)))
        .withColumn("authority", F.when(at(4) != "", F.lower(at(4)))).withColumn("country", F.when(F.col("directive") == "MANAGERDOMAIN", country))
    )
    four = F.size("fields") == 4
    problem = either(
        (F.col("directive") == "MANAGERDOMAIN", F.when(
            F.col("domain").isNull() | (F.size("parts") > 2) | ~F.coalesce(F.col("country").rlike("^[A-Z]{2}$"), F.lit(True)), "INVALID_MANAGERDOMAIN")),
        (F.col("directive") == "CONTACT", F.when(F.col("directive_value") == "", "EMPTY_CONTACT")),
        (F.col("directive").isNotNull(), F.when(F.col("domain").isNull(), F.concat(F.lit("INVALID_"), "directive"))),
        (~F.size("fields").isin(3, 4), "INVALID_FIELD_COUNT"),
        (F.col("domain").isNull(), "INVALID_DOMAIN"),
        ((F.col("account") == "") | (F.length("account") > 500), "INVALID_ACCOUNT_ID"),
        (~F.col("relationship").isin("DIRECT", "RESELLER"), "INVALID_RELATIONSHIP"),
        (four & (F.col("authority").isNull() | (F.length("authority") > 255)), "INVALID_CERT_AUTHORITY"),
    )
    kind = either((F.col("directive").isNotNull(), "DIRECTIVE"), (F.col("problem").isNotNull(), "INVALID"), otherwise="RECORD")
    identity = T.record_hash(F.col("domain"), F.col("account"), F.col("relationship"), F.col("authority"))
    return (
        df.withColumn("problem", problem).withColumn("kind", kind)
        .withColumn("record_hash", F.when(F.col("kind") == "RECORD", identity))
        .select("file_id", "line_no", "kind", "directive", "domain", "country", "account", "relationship", "authority", "record_hash", "problem")
    )


def ads_diagnosed(lines: DataFrame) -> DataFrame:
    """Adds what depends on other lines: duplicate records, later owners, records past the bound.

    All windows share the partitioning by file, so the lines move once.
    """
    per_file = Window.partitionBy("file_id")
    so_far = per_file.orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    record = F.col("kind") == "RECORD"
    valid_owner = (F.col("directive") == "OWNERDOMAIN") & F.col("domain").isNotNull()
    df = lines.withColumn("_first", F.min("line_no").over(Window.partitionBy("file_id", "record_hash")))
    df = df.withColumn("_owner", F.min(F.when(valid_owner, F.col("line_no"))).over(per_file))
    df = df.withColumn("_new", record & (F.col("line_no") == F.col("_first")))
    df = df.withColumn("_held", F.coalesce(F.count_if("_new").over(so_far), F.lit(0)))
    extra = either(
        (record & (F.col("_held") >= MAX_RECORDS), "RECORD_LIMIT_EXCEEDED"),
        (record & ~F.col("_new"), "DUPLICATE_RECORD"),
        (valid_owner & (F.col("line_no") > F.col("_owner")), "DUPLICATE_OWNERDOMAIN"),
    )
    return df.select(
        *lines.columns[:-1], F.coalesce("problem", extra).alias("problem"), (F.col("_new") & (F.col("_held") < MAX_RECORDS)).alias("is_first"),
        F.coalesce(valid_owner & (F.col("line_no") == F.col("_owner")), F.lit(False)).alias("is_owner"),
    )


def ads_records(files: DataFrame) -> DataFrame:
    """Distinct seller records per file; the first line of a record stands for it."""
    return ads_diagnosed(ads_lines(files)).where("is_first").select(
        "file_id", "line_no", "domain", "account", "relationship", "authority", "record_hash"
    )


def ads_file_state(files: DataFrame) -> DataFrame:
    """Status, counts, owner, managers and semantic hash per file; order and comments do not matter."""
    lines = ads_diagnosed(ads_lines(files))
    manager = F.when((F.col("directive") == "MANAGERDOMAIN") & F.col("problem").isNull(), F.concat_ws(":", "domain", "country"))
    state = lines.groupBy("file_id").agg(
        F.count("*").alias("meaningful"), F.count_if("is_first").alias("records"),
        F.count_if(F.col("problem") == "DUPLICATE_RECORD").alias("duplicates"),
        F.count_if((F.col("kind") == "INVALID") | (F.col("problem") == "RECORD_LIMIT_EXCEEDED")).alias("invalid_rows"),
        F.count_if(F.col("problem").isNotNull()).alias("diagnostics"),
        F.max(F.when(F.col("is_owner"), F.col("domain"))).alias("owner_domain"),
        F.array_sort(F.collect_set(manager)).alias("managers"),
        F.array_sort(F.collect_set(F.when(F.col("is_first"), F.col("record_hash")))).alias("_hashes"),
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    status = either(
        (n("meaningful") == 0, "EMPTY"), (n("records") == 0, "INVALID"), (n("diagnostics") > 0, "VALID_WITH_WARNINGS"), otherwise="VALID"
    )
    empty = F.array().cast("array<string>")
    semantic = F.sha2(
        F.concat_ws("|", F.array_join(F.coalesce("_hashes", empty), ","), F.coalesce("owner_domain", F.lit("")), F.array_join(F.coalesce("managers", empty), ",")), 256
    )
    return files.select("file_id").join(state, "file_id", "left").select(
        "file_id", status.alias("parse_status"), n("records").alias("records"), n("invalid_rows").alias("invalid_rows"), n("duplicates").alias("duplicates"),
        "owner_domain", F.coalesce("managers", empty).alias("managers"), semantic.alias("semantic_hash"),
    )


def robots_lines(files: DataFrame) -> DataFrame:
    """Meaningful robots lines with group number, kind (AGENT, RULE, OTHER) and diagnostic."""
    lines = file_lines(files)
    has = F.contains("line", F.lit(":"))
    field = F.lower(_strip(F.substring_index("line", ":", 1)))
    value = _strip(F.substr("line", F.locate(":", "line") + 1))
    df = lines.select("file_id", "line_no", has.alias("has"), F.when(has, field).alias("field"), F.when(has, value).alias("value"))
    agent = (F.col("field") == "user-agent") & F.col("value").rlike(AGENT)
    rule = F.col("field").isin("allow", "disallow")
    df = df.withColumn("kind", either((F.coalesce(agent, F.lit(False)), "AGENT"), (F.coalesce(rule, F.lit(False)), "RULE"), otherwise="OTHER"))
    marks = F.when(F.col("kind") != "OTHER", F.col("kind"))
    order = Window.partitionBy("file_id").orderBy("line_no")
    before = F.last(marks, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_opens", (F.col("kind") == "AGENT") & ~before.eqNullSafe(F.lit("AGENT")))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("group_no", F.sum(F.when(F.col("_opens"), 1).otherwise(0)).over(upto))
    pattern = U.norm_octets(F.col("value"))
    ok = U.octets_valid(F.col("value")) & F.startswith(pattern, F.lit("/"))
    problem = either(
        (~F.col("has"), "MISSING_SEPARATOR"),
        ((F.col("field") == "user-agent") & (F.col("kind") == "OTHER"), "INVALID_USER_AGENT"),
        ((F.col("kind") == "RULE") & (F.col("group_no") == 0), "RULE_WITHOUT_AGENT"),
        ((F.col("kind") == "RULE") & (F.col("value") != "") & ~ok, "INVALID_RULE"),
        ((F.col("field") == "sitemap") & (F.length("value") > 500), "SITEMAP_TOO_LONG"),
    )
    usable = (F.col("kind") == "RULE") & (F.col("group_no") > 0) & (F.col("value") != "") & ok
    return df.withColumn("problem", problem).withColumn("pattern", F.when(usable, pattern)).drop("_opens", "has")


def robots_rules(files: DataFrame) -> DataFrame:
    """Merged rules: (file_id, agent, directive, pattern); an agent without rules keeps one bare row."""
    lines = robots_lines(files).where((F.col("kind") == "AGENT") | F.col("pattern").isNotNull())
    # Four branches read the lines; written once, the files are not parsed again in each.
    lines = written(lines.select("file_id", "group_no", "kind", "field", "value", "pattern"), "robots-lines")
    agents = lines.where(F.col("kind") == "AGENT").select("file_id", "group_no", F.lower("value").alias("agent")).distinct()
    rules = lines.where(F.col("pattern").isNotNull()).select("file_id", "group_no", F.col("field").alias("directive"), "pattern")
    joined = agents.join(rules, ["file_id", "group_no"], "left").select("file_id", "agent", "directive", "pattern").distinct()
    has_rule = joined.where(F.col("pattern").isNotNull()).select("file_id", "agent").distinct()
    bare = joined.where(F.col("pattern").isNull()).join(has_rule, ["file_id", "agent"], "left_anti")
    return joined.where(F.col("pattern").isNotNull()).unionByName(bare)


def robots_state(files: DataFrame) -> DataFrame:
    """Status, sizes, semantic hash and whether the whole site is closed to everyone."""
    lines, rules = robots_lines(files), robots_rules(files)
    seen = lines.groupBy("file_id").agg(F.count("*").alias("meaningful"), F.count_if(F.col("problem").isNotNull()).alias("diagnostics"))
    star = F.col("agent") == "*"
    line = F.concat_ws("|", "agent", F.coalesce("directive", F.lit("")), F.coalesce("pattern", F.lit("")))
    state = rules.groupBy("file_id").agg(
        F.countDistinct("agent").alias("groups"), F.count("pattern").alias("rules"),
        F.coalesce(F.bool_or(star & (F.col("directive") == "disallow") & (F.col("pattern") == "/")), F.lit(False)).alias("closed"),
        F.coalesce(F.bool_or(star & (F.col("directive") == "allow")), F.lit(False)).alias("opened"),
        F.array_join(F.array_sort(F.collect_list(line)), ",").alias("_text"),
    )
    n = lambda c: F.coalesce(c, F.lit(0))
    status = either(
        (n("meaningful") == 0, "EMPTY"), (n("groups") == 0, "INVALID"), (n("diagnostics") > 0, "VALID_WITH_WARNINGS"), otherwise="VALID"
    )
    return files.select("file_id").join(seen, "file_id", "left").join(state, "file_id", "left").select(
        "file_id", status.alias("parse_status"), n("groups").alias("groups"), n("rules").alias("rules"),
        F.coalesce(F.col("closed") & ~F.col("opened"), F.lit(False)).alias("broad_blocked"), F.sha2(F.coalesce("_text", F.lit("")), 256).alias("semantic_hash"),
    )


def rule_regex(pattern: Column) -> Column:
    """A robots pattern as an anchored regular expression."""
    ends = F.endswith(pattern, F.lit("$"))
    core = F.regexp_replace(pattern, r"\$$", "")
    quoted = F.regexp_replace(F.regexp_replace(core, r"([.+?^$\{\}()|\[\]\\])", r"\\$1"), r"\*+", ".*")
    return F.concat(F.lit("(?s)^"), quoted, F.when(ends, "$").otherwise(""))


def literal_prefix(pattern: Column) -> Column:
    """What every path that the pattern matches begins with."""
    return F.substring_index(F.regexp_replace(pattern, r"\$$", ""), "*", 1)


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Whether each URL may be fetched.  URLs: url_id, file_id, user_agent, path.

    The longest matching agent decides, then its longest matching rule, then allow.  Rules are an index by the literal text
    they begin with: a path is cut to the lengths that occur among the rules of its agent and meets only rules that begin
    with one of these cuts; only those with a wildcard or an end anchor are then held against their pattern.  So a URL meets
    the rules of its own branch, not all of its file.  A null path matches no rule, a null user agent only the agent ``*``.
    """
    rules = written(rules, "robots-rules")
    asked = urls.select(
        "url_id", "file_id", U.norm_octets(F.col("path")).alias("_path"), F.coalesce(F.lower("user_agent"), F.lit("")).alias("_agent")
    )
    agents = rules.select("file_id", "agent", F.when(F.col("agent") == "*", 0).otherwise(F.length("agent")).alias("_len")).distinct()
    mine = asked.select("file_id", "_agent").distinct().join(agents, "file_id").where((F.col("agent") == "*") | F.contains("_agent", F.col("agent")))
    longest = F.max("_len").over(Window.partitionBy("file_id", "_agent"))
    chosen = mine.withColumn("_longest", longest).where("_len = _longest").select("file_id", "_agent", "agent")
    pattern = F.col("pattern")
    index = rules.where(pattern.isNotNull()).select(
        "file_id", "agent", literal_prefix(pattern).alias("_prefix"), (F.contains(pattern, F.lit("*")) | F.endswith(pattern, F.lit("$"))).alias("_wild"),
        rule_regex(pattern).alias("_regex"), F.struct(U.octet_length_of_rule(pattern).alias("octets"), (F.col("directive") == "allow").alias("allow")).alias("_verdict"),
    )
    # At most one length for each character of the longest rule.
    lengths = index.groupBy("file_id", "agent").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    placed = asked.join(chosen, ["file_id", "_agent"]).join(lengths, ["file_id", "agent"])
    cuts = placed.select("url_id", "file_id", "agent", "_path", F.explode("_lengths").alias("_n")).where(F.col("_n") <= F.length("_path"))
    cuts = cuts.withColumn("_prefix", F.substring(F.col("_path"), F.lit(1), F.col("_n"))).drop("_n")
    hits = cuts.join(index, ["file_id", "agent", "_prefix"]).where(~F.col("_wild") | F.rlike("_path", F.col("_regex")))
    best = hits.groupBy("url_id").agg(F.max("_verdict").alias("best"))
    return urls.join(best, "url_id", "left").select(*urls.columns, F.coalesce("best.allow", F.lit(True)).alias("allowed"))


def config_outcome(fetches: DataFrame) -> DataFrame:
    """Fetch result to status; null where the body still has to be parsed."""
    http, error = F.col("http_status"), F.col("error_code")
    return fetches.withColumn(
        "outcome",
        either(
            (error == "PUBLIC_CONFIG_TOO_LARGE", "TOO_LARGE"), (error == "PUBLIC_CONFIG_SECURITY_ERROR", "BLOCKED"), (error.isNotNull(), "UNREACHABLE"),
            (http == 200, None), (http.isin(404, 410), "MISSING"), ((F.col("config_type") == "ROBOTS_TXT") & (http >= 500), "UNREACHABLE"), otherwise="HTTP_ERROR",
        ),
    )


def config_predecessors(snapshots: DataFrame, bucket_s: int = DAY) -> DataFrame:
    """Adds previous, healthy and condition predecessors and the effective previous snapshot.

    Snapshots: snapshot_id, site, config_type, observed_at, parse_status, fetch_kind,
    semantic_hash, broad_blocked, normalizer_version.  Only scheduled snapshots of the same
    normalizer serve as predecessors.
    """
    me = F.struct("observed_at", "snapshot_id", "parse_status", "semantic_hash", "broad_blocked")
    scheduled = F.col("fetch_kind") == "SCHEDULED"
    healthy = F.col("parse_status").isin(*HEALTHY_CONFIG_STATUSES)
    condition = F.col("parse_status").isin(*ADS_CONDITION_CODES) & (F.col("config_type") == "ADS_TXT")
    found = latest_before(
        snapshots, ["site", "config_type", "normalizer_version"], "observed_at",
        {"previous": F.when(scheduled, me), "previous_healthy": F.when(scheduled & healthy, me), "previous_condition": F.when(scheduled & condition, me)},
        bucket_s,
    )
    recovering = (
        (F.col("config_type") == "ADS_TXT") & healthy
        & ~F.coalesce(F.col("previous.parse_status").isin(*ADS_CONDITION_CODES), F.lit(False))
        & F.col("previous_condition").isNotNull()
        & (F.col("previous_healthy").isNull() | (F.col("previous_condition.observed_at") > F.col("previous_healthy.observed_at")))
    )
    return found.withColumn("effective", F.when(recovering, F.col("previous_condition")).otherwise(F.col("previous")))


def validation_pair(snapshots: DataFrame, validations: DataFrame) -> DataFrame:
    """Adds the validation of each snapshot and whether it agrees: same status, and same hash if either has one.

    Validations: validation_of, validation_id, observed_at, parse_status, semantic_hash, normalizer_version.
    """
    first = validations.groupBy(F.col("validation_of").alias("snapshot_id")).agg(
        F.min_by(F.struct("validation_id", "observed_at", "parse_status", "semantic_hash", "normalizer_version"), "validation_id").alias("validation")
    )
    agrees = (F.col("validation.parse_status") == F.col("parse_status")) & F.col("validation.semantic_hash").eqNullSafe(F.col("semantic_hash"))
    return snapshots.join(first, "snapshot_id", "left").withColumn("agrees", F.coalesce(agrees, F.lit(False)))


def needs_second_check(found: DataFrame) -> DataFrame:
    """Adds ``second_check`` to the output of config_predecessors."""
    healthy, condition = F.col("previous_healthy"), F.col("previous_condition")
    robots = F.col("broad_blocked") & ~F.coalesce(healthy["broad_blocked"], F.lit(False))
    good = F.col("parse_status").isin(*HEALTHY_CONFIG_STATUSES)
    back = good & condition.isNotNull() & (condition["observed_at"] > healthy["observed_at"])
    ads = F.col("parse_status").isin(*ADS_CONDITION_CODES) | back
    needed = healthy.isNotNull() & F.when(F.col("config_type") == "ROBOTS_TXT", F.coalesce(robots, F.lit(False))).otherwise(F.coalesce(ads, F.lit(False)))
    return found.withColumn("second_check", needed)


def config_transitions(judged: DataFrame) -> DataFrame:
    """(code, action) or skip reason per snapshot, from predecessors and validation pairs."""
    before, check = F.col("effective"), F.col("validation")
    healthy = F.col("parse_status").isin(*HEALTHY_CONFIG_STATUSES)
    was_healthy = before["parse_status"].isin(*HEALTHY_CONFIG_STATUSES)
    bad, was_bad = F.col("parse_status").isin(*ADS_CONDITION_CODES), before["parse_status"].isin(*ADS_CONDITION_CODES)
    same = before["semantic_hash"] == F.col("semantic_hash")
    no_hash = before["semantic_hash"].isNull() | F.col("semantic_hash").isNull()
    robots, agrees = F.col("config_type") == "ROBOTS_TXT", F.col("agrees")
    added = ~F.coalesce(before["broad_blocked"], F.lit(False)) & F.coalesce("broad_blocked", F.lit(False))
    removed = F.coalesce(before["broad_blocked"], F.lit(False)) & ~F.coalesce("broad_blocked", F.lit(False))
    skip = either(
        (F.col("fetch_kind") != "SCHEDULED", "PRIMARY_NOT_SCHEDULED"),
        (check.isNotNull() & (check["normalizer_version"] != F.col("normalizer_version")), "INCOMPATIBLE_PUBLIC_CONFIG_NORMALIZER"),
        (check.isNotNull() & (check["observed_at"] < F.col("observed_at")), "UNORDERED_VALIDATION_TIME"),
        (before.isNull(), "FIRST_SEMANTIC_BASELINE"),
        (robots & ~(healthy & was_healthy), "NON_SEMANTIC_ROBOTS_STATE"),
        (robots & no_hash, "MISSING_SEMANTIC_HASH"),
        (robots & same, "UNCHANGED_SEMANTIC_STATE"),
        (robots & added & ~agrees, "AWAITING_OR_DISAGREEING_VALIDATION"),
        (~robots & bad & ~agrees, "AWAITING_OR_DISAGREEING_VALIDATION"),
        (~robots & healthy & was_bad & ~agrees, "AWAITING_OR_DISAGREEING_RECOVERY_VALIDATION"),
        (~robots & healthy & ~was_bad & ~was_healthy, "NON_COMPARABLE_ADS_STATE"),
        (~robots & healthy & was_healthy & no_hash, "MISSING_SEMANTIC_HASH"),
        (~robots & healthy & was_healthy & same, "UNCHANGED_SEMANTIC_STATE"),
        (~robots & ~healthy & ~bad, "NON_SEMANTIC_ADS_STATE"),
    )
    condition_code = either(*[(F.col("parse_status") == s, F.lit(c)) for s, c in ADS_CONDITION_CODES.items()])
    one = lambda code, action: F.array(F.struct(code.alias("code"), F.lit(action).alias("action")))
    recovered = F.array(*[F.struct(F.lit(c).alias("code"), F.lit("RESOLVE").alias("action")) for c in ADS_CONDITION_CODES.values()])
    found = either(
        (F.col("skip").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("action")))),
        (robots & added, one(F.lit("ROBOTS_BROAD_BLOCK_ADDED"), "RECORD")),
        (robots & removed, one(F.lit("ROBOTS_BROAD_BLOCK_REMOVED"), "RECORD")),
        (robots, one(F.lit("ROBOTS_TXT_CHANGED"), "RECORD")),
        (bad & (before["parse_status"] == F.col("parse_status")), one(condition_code, "SUPPORT")),
        (bad, one(condition_code, "UPSERT")),
        (was_bad, recovered),
        otherwise=one(F.lit("ADS_TXT_CHANGED"), "RECORD"),
    )
    return judged.withColumn("skip", skip).withColumn("_e", F.explode(found)).select(
        "snapshot_id", "site", "config_type", "observed_at", "_e.code", "_e.action", "skip"
    )


# --- fixed values: HTML patterns and bounds ------------------------------------------------------
META_TAG, LINK_TAG = r"(?i)<meta\s[^>]*>", r"(?i)<link\s[^>]*>"
ATTR = r'(?is)\s{name}\s*=\s*"([^"]*)"'
OPEN_TAG = r"<[a-zA-Z][a-zA-Z0-9]*(?:\s[^<>]*)?>"
SAFE_ATTRS = r'(?i)\s(aria-hidden|data-ad-unit|data-testid|defer|hidden|id|itemprop|name|property|rel|role|type)(?:\s*=\s*"[^"]*")?'
REFERENCE = r'(?i)<(script|link|iframe|a)\s(?:[^>]*?\s)?(?:src|href)="([^"]*)"'
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def _attr(tag: Column, name: str) -> Column:
    return F.regexp_extract(tag, ATTR.format(name=name), 1)


def page_seo(pages: DataFrame) -> DataFrame:
    """Title hash, merged robots directives and first canonical link of each page (regex scan)."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    for entity, character in ENTITIES:
        title = F.replace(title, F.lit(entity), F.lit(character))
    robots = F.filter(F.regexp_extract_all("html", F.lit(META_TAG), F.lit(0)), lambda tag: F.lower(F.trim(_attr(tag, "name"))) == "robots")
    merged = F.array_sort(F.array_distinct(T.directives(F.array_join(F.transform(robots, lambda tag: _attr(tag, "content")), ","))))
    links = F.filter(
        F.regexp_extract_all("html", F.lit(LINK_TAG), F.lit(0)), lambda tag: F.array_contains(F.split(F.lower(_attr(tag, "rel")), r"\s+"), "canonical")
    )
    return pages.select(
        "page_id", T.title_hash(title).alias("title_hash"), F.nullif(F.array_join(merged, ","), F.lit("")).alias("meta_robots"),
        U.canonical_url(_attr(F.try_element_at(links, F.lit(1)), "href"), F.col("url")).alias("canonical_url"),
    )


def page_structure(pages: DataFrame) -> DataFrame:
    """Structural fingerprint: open tags in order with their safe attributes."""
    tags = F.regexp_extract_all("html", F.lit(OPEN_TAG), F.lit(0))
    name = lambda tag: F.lower(F.regexp_extract(tag, r"^<([a-zA-Z][a-zA-Z0-9]*)", 1))
    kept = lambda tag: F.array_sort(F.transform(F.regexp_extract_all(tag, F.lit(SAFE_ATTRS), F.lit(0)), lambda a: T.mask_volatile(F.lower(a))))
    node = lambda tag: F.concat_ws(" ", F.array(name(tag)), kept(tag))
    shaped = pages.select("page_id", tags.alias("tags")).select(
        "page_id", F.size("tags").alias("nodes"), F.transform("tags", node).alias("seq")
    )
    return shaped.select(
        "page_id", F.col("nodes").cast("bigint").alias("node_count"), F.sha2(F.array_join("seq", "\n"), 256).alias("structure_hash"),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """References of each page with dependency identity and category."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(REFERENCE), F.lit(1)).alias("tag"), F.regexp_extract_all("html", F.lit(REFERENCE), F.lit(2)).alias("href")
    )
    refs = pages.select("page_id", "url", F.explode(found).alias("f")).select(
        "page_id", F.lower("f.tag").alias("tag"), U.canonical_url(F.col("f.href"), F.col("url")).alias("target")
    )
    return refs.where(F.col("target").isNotNull()).select(
        "page_id", "tag", U.dependency_key(F.col("target"), F.col("tag")).alias("stable_key"),
        U.dependency_category(U.host(F.col("target")), T.path_family(U.path(F.col("target")))).alias("category"),
    )
