"""Registered queries and the SQL they are checked against.

The driver's tables stand in for the experiments' own: users of `events` are videos, event_id
modulo 2 and 5 are condition and seed, value is a score; documents have a source (site) and a lang
(dish); numeric columns of `lineitem` scaled to 0..255 are pixel channels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pixels, scalar, vectors
from ..operators import backbones, distinct, matching, nested, ordered, ranking, rates, sequence, splits
from ..session import table
from ..sources import inventory
from . import stores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(stores.QUERIES)
ORACLES: dict[str, str] = dict(stores.ORACLES)
Load = Callable[[str], DataFrame]


def query(sql: str | None = None):
    """Registers a function of a table loader under its name, with its SQL."""

    def add(f: Callable[[Load], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


T_SQL = "CASE {n} - 1 " + " ".join(f"WHEN {k} THEN {t}" for k, t in scalar.T95.items()) + " ELSE {fallback} END"
DRAW_SQL = "('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8))::BIGINT"


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


def trials(t: Load) -> DataFrame:
    """events as trials: cond, seed, video, hit."""
    return t("events").select((F.col("event_id") % 2).alias("cond"), (F.col("event_id") % 5).alias("seed"), F.col("user_id").alias("video"), (F.col("value") >= 25).alias("hit"), "event_type", "value")


TRIALS = "(SELECT event_id % 2 AS cond, event_id % 5 AS seed, user_id AS video, value >= 25 AS hit, event_type, value FROM events)"
CELLS = f"(SELECT cond, seed, video, CASE WHEN count(*) FILTER (WHERE event_type <> 'error') > 0 THEN count(*) FILTER (WHERE hit AND event_type <> 'error')::DOUBLE / count(*) FILTER (WHERE event_type <> 'error') END AS rate FROM {TRIALS} GROUP BY ALL)"
MACRO = f"""SELECT cond, count(unit) AS n, avg(unit) AS mean, coalesce(stddev_samp(unit), 0) AS sd FROM
(SELECT cond, video, avg(rate) AS unit FROM {CELLS} GROUP BY ALL) WHERE unit IS NOT NULL GROUP BY cond"""
MACRO_CI = f"SELECT cond, n, mean, sd, CASE WHEN n > 1 THEN {T_SQL.format(n='n', fallback=1.96)} * sd / sqrt(n) ELSE 0 END AS ci FROM ({MACRO})"


def cells(t: Load) -> DataFrame:
    return rates.cell_rates(trials(t), ["cond", "seed", "video"], F.col("hit"), F.col("event_type") != "error")


# ---- sources and names


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_projection(t: Load) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query(r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^/?]+)', 1) AS first_dir,
regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS base FROM pages""")
def url_key_parse(t: Load) -> DataFrame:
    return t("pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?]+)", 1).alias("first_dir"), scalar.basename(F.substring_index("url", "?", 1)).alias("base"))


@query(r"""WITH n AS (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 5, '0') || '_run_' || CAST(s_nationkey AS VARCHAR) || '_x_s' || CAST(s_suppkey % 3 AS VARCHAR) || '.tar.gz' AS path FROM supplier)
SELECT s_suppkey, regexp_replace(path, '^[0-9]{5}_', '') AS stripped, regexp_replace(path, '(.)\.[^.]*$', '\1') AS stem, '.gz' AS suffix FROM n""")
def name_parts(t: Load) -> DataFrame:
    path = F.concat(F.lpad(F.col("s_suppkey").cast("string"), 5, "0"), F.lit("_run_"), F.col("s_nationkey").cast("string"), F.lit("_x_s"), (F.col("s_suppkey") % 3).cast("string"), F.lit(".tar.gz"))
    return t("supplier").select("s_suppkey", scalar.strip_serial(path).alias("stripped"), scalar.stem(path).alias("stem"), scalar.suffix(path).alias("suffix"))


@query("SELECT s_suppkey, 'v8' AS tag, 'c' || CAST(s_nationkey AS VARCHAR) || '_x' AS cfg, CAST(s_suppkey % 3 AS INTEGER) AS seed FROM supplier")
def model_run_discovery(t: Load) -> DataFrame:
    name = F.concat(F.lit("v8_c"), F.col("s_nationkey").cast("string"), F.lit("_x_s"), (F.col("s_suppkey") % 3).cast("string"))
    return t("supplier").select("s_suppkey", scalar.run_parts(name).alias("r")).filter("r is not null").select("s_suppkey", "r.tag", "r.cfg", "r.seed")


@query("""SELECT l_orderkey, l_partkey, 0 AS cls, round(l_discount, 6) AS cx, round(l_tax, 6) AS cy, 0.25::DOUBLE AS w, 0.5::DOUBLE AS h, count(*) AS n
FROM lineitem WHERE l_linenumber <> 3 GROUP BY ALL""")
def label_line_parse(t: Load) -> DataFrame:
    line = F.concat_ws(" ", F.lit("0"), F.col("l_discount").cast("string"), F.col("l_tax").cast("string"), F.lit("0.25"), F.when(F.col("l_linenumber") != 3, "0.5 "))
    parsed = inventory.label_lines(t("lineitem").select("l_orderkey", "l_partkey", line.alias("value")))
    return rounded(parsed, "cx", "cy").groupBy("l_orderkey", "l_partkey", "cls", "cx", "cy", "w", "h").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, coalesce(n, 0) AS boxes, coalesce(n, 0) > 0 AS is_positive FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def polarity_by_labels(t: Load) -> DataFrame:
    labels = t("lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return inventory.with_polarity(t("orders").select("o_orderkey"), labels, "o_orderkey")


@query("SELECT l_orderkey, count(*) AS n FROM (SELECT l_orderkey FROM lineitem UNION ALL SELECT l_orderkey FROM lineitem UNION ALL SELECT o_orderkey FROM orders) GROUP BY 1")
def bag_union_twice(t: Load) -> DataFrame:
    own = t("lineitem").select("l_orderkey")
    return inventory.training_rows(own, own, t("orders").select(F.col("o_orderkey").alias("l_orderkey"))).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def resumable_grid(t: Load) -> DataFrame:
    done = t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return inventory.to_do(t("customer").select("c_custkey"), done, ["c_custkey"])


@query("""SELECT user_id, coalesce(max(value) FILTER (WHERE event_type = 'click'), 1.5) AS v0, coalesce(max(value) FILTER (WHERE event_type = 'none'), 200.0) AS core0 FROM events GROUP BY 1""")
def defaults_overlay(t: Load) -> DataFrame:
    given = t("events").groupBy("user_id").agg(F.struct(F.max(F.when(F.col("event_type") == "click", F.col("value"))).alias("v0"), F.max(F.when(F.col("event_type") == "none", F.col("value"))).alias("core0")).alias("g"))
    return given.select("user_id", *scalar.overlay(F.col("g"), {"v0": F.lit(1.5), "core0": F.lit(200.0)}))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY 1")
def parameterised_key_filter(t: Load) -> DataFrame:
    return t("events").filter(scalar.wanted(F.col("event_type"), "click,error")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CAST(floor(value * 10) AS BIGINT) // 60 || ':' || lpad(CAST(CAST(floor(value * 10) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS mmss,
round_even(value, 1) AS half_even FROM events""")
def time_and_rounding(t: Load) -> DataFrame:
    return t("events").select("event_id", scalar.minutes(F.col("value") * 10).alias("mmss"), F.bround("value", 1).alias("half_even"))


@query("""SELECT page_id, split_part(url, '/', -2) AS site, split_part(url, '/', -1) AS file, regexp_extract(url, '^[a-z]+://[^/]+/([^/]*)', 1) AS class,
CASE WHEN len(string_split(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '/')) > 2 THEN split_part(regexp_extract(url, '^[a-z]+://[^/]+/(.*)$', 1), '/', 2) ELSE '_flat' END AS scene FROM pages""")
def folder_levels(t: Load) -> DataFrame:
    files = inventory.path_levels(t("pages").select("page_id", F.col("url").alias("path")), ["site"])
    return inventory.class_scene(files, "^[a-z]+://[^/]+").select("page_id", "site", scalar.basename(F.col("path")).alias("file"), "class", "scene")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS seconds FROM events")
def duration_probe(t: Load) -> DataFrame:
    probe = F.concat(F.lit('{"format": {"duration": "'), F.get_json_object("props", "$.k"), F.lit('"}}'))
    return t("events").select("event_id", inventory.duration(probe).alias("seconds"))


@query("""SELECT p_partkey, 'Brand#' || split_part(split_part(p_brand, '#', 2), '_', 1) AS key, CASE WHEN b = 1 THEN 'test' ELSE 'train' END AS pool FROM
(SELECT p_partkey, p_brand, CAST(regexp_extract(p_brand, '([0-9])[0-9]*$', 1) AS INTEGER) AS b FROM part) WHERE b <= 3""")
def pool_assignment(t: Load) -> DataFrame:
    first = F.regexp_extract("p_brand", "([0-9])[0-9]*$", 1).cast("int")
    brands = t("part").select(F.col("p_brand").alias("key"), F.when(first == 1, "test").when(first <= 3, "train").alias("pool")).distinct().filter("pool is not null")
    split = brands.groupBy("pool").agg(F.sort_array(F.collect_list("key")).alias("keys")).agg(F.map_from_entries(F.collect_list(F.struct("pool", "keys"))).alias("pools"))
    return inventory.pool_of(t("part").select("p_partkey", "p_brand"), inventory.pool_members(split), F.concat("p_brand", F.lit("_x"))).select("p_partkey", "key", "pool")


@query("SELECT doc_id, strlen(nfc_normalize(text)) AS n_bytes FROM documents")
def unicode_nfc(t: Load) -> DataFrame:
    return t("documents").select("doc_id", F.octet_length(scalar.nfc("text")).cast("long").alias("n_bytes"))


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE event_type = 'click') > 0")
def non_empty_arrays(t: Load) -> DataFrame:
    per = t("events").groupBy("user_id").agg(F.collect_list(F.when(F.col("event_type") == "click", F.col("event_id"))).alias("a"))
    return per.filter(scalar.has_any(F.col("a"))).select("user_id", F.size("a").cast("long").alias("clicks"))


# ---- splits


PARTS = f"(SELECT *, CASE WHEN {DRAW_SQL.format(key='source', seed=0)}::DOUBLE / 4294967296 < 0.7 THEN 'train' WHEN {DRAW_SQL.format(key='source', seed=0)}::DOUBLE / 4294967296 < 0.85 THEN 'val' ELSE 'test' END AS part FROM documents)"


def parted(t: Load) -> DataFrame:
    return splits.assign_groups(t("documents"), "source", [("train", 0.7), ("val", 0.15), ("test", 0.15)])


@query(f"SELECT part, count(*) AS n, count(DISTINCT source) AS sources FROM {PARTS} GROUP BY 1")
def group_split_assignment(t: Load) -> DataFrame:
    return parted(t).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))


@query(f"SELECT count(*) AS spread FROM (SELECT source FROM {PARTS} GROUP BY 1 HAVING count(DISTINCT part) > 1)")
def split_disjointness(t: Load) -> DataFrame:
    return splits.spread_groups(parted(t), "source").agg(F.count("*").alias("spread"))


@query(f"SELECT md5(text) AS digest, count(DISTINCT part) AS parts, count(*) AS n FROM {PARTS} GROUP BY 1 HAVING count(DISTINCT part) > 1")
def content_leak_across_split(t: Load) -> DataFrame:
    return splits.leaked_content(parted(t), F.col("text"))


@query("SELECT source, " + ", ".join(f"count(*) FILTER (WHERE lang = '{v}') AS {v}" for v in ("en", "fr", "de", "es", "xx")) + " FROM documents GROUP BY 1")
def crosstab_zero_filled(t: Load) -> DataFrame:
    return splits.crosstab(t("documents"), "source", "lang", ["en", "fr", "de", "es", "xx"])


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def subtotals_rollup(t: Load) -> DataFrame:
    return splits.subtotals(t("documents"), "source", "lang")


@query(f"SELECT doc_id, CASE WHEN u < 0.60 THEN 'pos' WHEN u < 0.75 THEN 'hardneg' ELSE 'neg' END AS role FROM (SELECT doc_id, {DRAW_SQL.format(key='doc_id', seed=7)}::DOUBLE / 4294967296 AS u FROM documents)")
def role_assignment(t: Load) -> DataFrame:
    u = scalar.draw(F.col("doc_id"), 7).cast("double") / F.lit(float(1 << 32))
    return t("documents").select("doc_id", F.when(u < 0.60, "pos").when(u < 0.75, "hardneg").otherwise("neg").alias("role"))


@query("""WITH e AS (SELECT p_partkey AS k FROM part WHERE p_size <= 30), a AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 45)
SELECT k, 'missing' AS status FROM e WHERE k NOT IN (SELECT k FROM a) UNION ALL SELECT k, 'extra' FROM a WHERE k NOT IN (SELECT k FROM e)""")
def reconcile_missing_extra(t: Load) -> DataFrame:
    actual = t("lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("k"))
    return splits.reconcile(t("part").filter("p_size <= 30").select(F.col("p_partkey").alias("k")), actual, "k")


@query("""SELECT o_orderkey AS k, coalesce(e, 0) AS expected, coalesce(a, 0) AS actual, coalesce(a, 0) - coalesce(e, 0) AS diff FROM
(SELECT o_orderkey, 4::BIGINT AS e FROM orders) FULL JOIN (SELECT l_orderkey, count(*) AS a FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE coalesce(a, 0) <> coalesce(e, 0)""")
def expected_vs_actual(t: Load) -> DataFrame:
    expected = t("orders").select(F.col("o_orderkey").alias("k"), F.lit(4).cast("long").alias("n"))
    return splits.expected_vs_actual(expected, t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n")), "k")


@query("""WITH s AS (SELECT source, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS q FROM labels JOIN documents USING (doc_id) GROUP BY 1),
g AS (SELECT sum(p)::BIGINT AS positives, sum(q)::BIGINT AS negatives, count(*) AS sources, max(p + q) AS largest FROM s)
SELECT positives, negatives, sources, negatives = 0 AS no_negatives, negatives > 0 AND positives > 0 AND greatest(positives, negatives) > 3 * greatest(1, least(positives, negatives)) AS imbalanced,
sources < 5 AS few_sources, largest > 0.6 * (positives + negatives) AS dominated FROM g""")
def screening_flags(t: Load) -> DataFrame:
    return splits.screen_sources(t("labels").join(t("documents").select("doc_id", "source"), "doc_id"), "source", F.col("quality") == 1)


@query(f"SELECT quality, doc_id FROM (SELECT quality, doc_id, row_number() OVER (PARTITION BY quality ORDER BY {DRAW_SQL.format(key='doc_id', seed=0)}, doc_id) AS k FROM labels) WHERE k <= 20")
def seeded_sample_per_class(t: Load) -> DataFrame:
    return splits.sample_per_class(t("labels"), "quality", "doc_id", 20).select("quality", "doc_id")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS k FROM documents WHERE text IS NOT NULL) WHERE k = 1")
def hash_dedup_keep_first(t: Load) -> DataFrame:
    return splits.keep_first_by_hash(t("documents"), F.col("text"), ["source", "doc_id"]).select("doc_id", "source")


@query("""SELECT max(abs(a - b)) AS max_diff, count(*) FILTER (WHERE abs(a - b) > 1e-9) AS mismatches, count(*) AS cells, CASE WHEN count(*) FILTER (WHERE abs(a - b) > 1e-9) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM
(SELECT l_returnflag AS k, round(sum(l_quantity), 3) AS a FROM lineitem GROUP BY 1) JOIN (SELECT l_returnflag AS j, round(sum(CASE WHEN l_linenumber = 7 THEN l_quantity + 1 ELSE l_quantity END), 3) AS b FROM lineitem GROUP BY 1) ON j = k""")
def result_audit(t: Load) -> DataFrame:
    old = t("lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity"), 3).alias("v"))
    new = t("lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.when(F.col("l_linenumber") == 7, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))), 3).alias("v"))
    return splits.audit(old, new, "l_returnflag", "v")


@query("""SELECT 'difference' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersection', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'bag', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'not_subset', count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation))""")
def set_operations(t: Load) -> DataFrame:
    a, b, c = t("customer").select(F.col("c_nationkey").alias("k")), t("supplier").select(F.col("s_nationkey").alias("k")), t("nation").select(F.col("n_nationkey").alias("k"))
    found = {"difference": a.subtract(b), "intersection": a.intersect(b), "union": a.union(b).distinct(), "bag": a.union(b), "not_subset": b.distinct().join(c, "k", "left_anti")}
    out = None
    for name, df in found.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT event_id, '$.props.k' AS path, CAST(props->>'$.k' AS VARCHAR) AS old, CAST(CAST(props->>'$.k' AS BIGINT) + 1 AS VARCHAR) AS new, 'changed' AS status FROM events WHERE event_id % 7 = 0
UNION ALL SELECT event_id, '$.tags[1].n', CAST(user_id % 5 AS VARCHAR), NULL, 'missing' FROM events WHERE event_id % 11 = 0
UNION ALL SELECT event_id, '$.type', '"' || event_type || '"', 'null', 'changed' FROM events WHERE event_id % 13 = 0
UNION ALL SELECT event_id, '$.note', NULL, '{}', 'extra' FROM events WHERE event_id % 17 = 0""")
def nested_audit(t: Load) -> DataFrame:
    """A JSON text against structs made of the same columns: a row for each path that differs."""
    i = F.col("event_id")
    tag = lambda n: F.struct((F.col("user_id") % n).alias("n"))
    events = t("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    made = F.concat(F.lit('{"props":'), "props", F.lit(',"type":"'), "event_type", F.lit('","tags":[{"n":'), (F.col("user_id") % 3).cast("string"), F.lit('},{"n":'), (F.col("user_id") % 5).cast("string"), F.lit("}]}"))
    plain = F.struct(F.struct(F.when(i % 7 == 0, F.col("k") + 1).otherwise(F.col("k")).alias("k")).alias("props"), F.when(i % 13 != 0, F.col("event_type")).alias("type"), F.when(i % 11 == 0, F.array(tag(3))).otherwise(F.array(tag(3), tag(5))).alias("tags"))
    with_note = F.parse_json(F.concat(F.expr("substr(to_json(v), 1, length(to_json(v)) - 1)"), F.lit(',"note":{}}')))
    new = events.select("event_id", F.to_variant_object(plain).alias("v")).withColumn("v", F.when(i % 17 == 0, with_note).otherwise(F.col("v")))
    return nested.differences(events.select("event_id", F.parse_json(made).alias("v")), new, "event_id", "v")


# ---- joins and matching


@query("""SELECT o_orderkey, n_name, r_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def inventory_lookup(t: Load) -> DataFrame:
    # nation and region are fixed inventories of a few rows
    places = t("nation").join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name", "r_name")


FRAGMENTS = "(SELECT DISTINCT 'NATION_' || CAST(n_regionkey * 5 AS VARCHAR) AS fragment FROM nation UNION SELECT 'NOWHERE')"


def fragments(t: Load) -> DataFrame:
    own = t("nation").select(F.concat(F.lit("NATION_"), (F.col("n_regionkey") * 5).cast("string")).alias("fragment"))
    return own.union(own.limit(1).select(F.lit("NOWHERE"))).distinct()


@query(f"SELECT fragment, min(n_name) AS n_name FROM {FRAGMENTS} JOIN nation ON contains(n_name, fragment) GROUP BY 1 HAVING count(*) = 1")
def unique_fuzzy_match(t: Load) -> DataFrame:
    return matching.unique_match(fragments(t), t("nation"), "fragment", "n_name")


@query(f"SELECT fragment, min(n_name) AS n_name FROM {FRAGMENTS} JOIN nation ON contains(n_name, fragment) GROUP BY 1")
def first_fuzzy_match(t: Load) -> DataFrame:
    return matching.first_match(fragments(t), t("nation"), "fragment", "n_name")


@query(f"SELECT fragment, count(n_name) AS hits, CASE count(n_name) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS status FROM {FRAGMENTS} LEFT JOIN nation ON contains(n_name, fragment) GROUP BY 1")
def match_status(t: Load) -> DataFrame:
    return matching.match_status(fragments(t), t("nation"), "fragment", "n_name")


HOSTS = r"(SELECT DISTINCT fragment FROM (SELECT regexp_extract(url, '://[^/]*', 0) AS fragment FROM pages UNION SELECT substr(url, 10, 5) FROM pages UNION SELECT 'q' || substr(url, -2) FROM pages))"


def page_fragments(t: Load) -> DataFrame:
    """Hosts, short pieces of addresses, and ends of addresses that seldom occur."""
    url = F.col("url")
    parts = [F.regexp_extract(url, "://[^/]*", 0), F.substring(url, 10, 5), F.concat(F.lit("q"), F.right(url, F.lit(2)))]
    return t("pages").select(F.explode(F.array(*parts)).alias("fragment")).distinct()


@query(f"SELECT fragment, min(url) AS url FROM {HOSTS} JOIN pages ON contains(url, fragment) GROUP BY 1 HAVING count(*) = 1")
def unique_fragment_in_pages(t: Load) -> DataFrame:
    return matching.unique_match(page_fragments(t), t("pages").select("url"), "fragment", "url")


@query(f"SELECT fragment, count(url) AS hits, CASE count(url) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS status FROM {HOSTS} LEFT JOIN pages ON contains(url, fragment) GROUP BY 1")
def fragment_status_in_pages(t: Load) -> DataFrame:
    return matching.match_status(page_fragments(t), t("pages").select("url"), "fragment", "url")


@query("SELECT item_id, min(doc_id) AS doc_id, count(*) AS hits FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 40)) GROUP BY 1")
def benchmark_openings_in_documents(t: Load) -> DataFrame:
    items = t("benchmark").select("item_id", F.substring("text", 1, 40).alias("opening"))
    return matching.fragment_hits(items, t("documents").select("doc_id", "text"), "opening", "text").groupBy("item_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("hits"))


@query("""WITH b AS (SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey DESC) AS k FROM lineitem WHERE l_returnflag = 'N') WHERE k = 1)
SELECT DISTINCT p.l_orderkey, p.l_partkey AS pos_part, b.l_partkey AS bg_part FROM lineitem p JOIN b ON p.l_orderkey = b.l_orderkey WHERE p.l_returnflag = 'R'""")
def paired_lookup(t: Load) -> DataFrame:
    items = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    last = matching.last_by_stem(items.filter("l_returnflag = 'N'"), "l_orderkey", "l_partkey").select("l_orderkey", F.col("l_partkey").alias("bg_part"))
    return items.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_partkey").alias("pos_part")).join(last, "l_orderkey").distinct()


@query("""WITH b AS (SELECT l_orderkey, max(l_partkey) AS bg FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
s AS (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT count(*) AS pairs, round(avg((f.score >= 30000)::INT), 6) AS rate_a, round(avg((g.score >= 30000)::INT), 6) AS rate_b, round(avg(f.score), 4) AS mean_a, round(avg(g.score), 4) AS mean_b, round(avg(f.score - g.score), 4) AS delta
FROM p JOIN b USING (l_orderkey) JOIN s f ON f.l_orderkey = p.l_orderkey AND f.l_partkey = p.l_partkey JOIN s g ON g.l_orderkey = b.l_orderkey AND g.l_partkey = b.bg""")
def paired_means(t: Load) -> DataFrame:
    pairs = paired_lookup(t)
    scores = t("lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("score"))
    side = lambda name, to: scores.select("l_orderkey", F.col("l_partkey").alias(name), F.col("score").alias(to))
    met = pairs.join(side("pos_part", "a"), ["l_orderkey", "pos_part"]).join(side("bg_part", "b"), ["l_orderkey", "bg_part"])
    got = rates.paired_means(met, "a", "b", 30000.0)
    return rounded(rounded(got, "rate_a", "rate_b"), "mean_a", "mean_b", "delta", digits=4)


SPANS = "(SELECT user_id * 37 AS a, user_id * 37 + 20 + user_id % 7 AS b, user_id AS span FROM (SELECT DISTINCT user_id FROM events))"


def spans(t: Load) -> DataFrame:
    u = F.col("user_id")
    return t("events").select("user_id").distinct().select((u * 37).alias("a"), (u * 37 + 20 + u % 7).alias("b"), u.alias("span"))


@query(f"SELECT event_id, span FROM events JOIN {SPANS} ON event_id >= a AND event_id <= b")
def interval_join_closed(t: Load) -> DataFrame:
    return sequence.interval_join(t("events"), "event_id", spans(t), True).select("event_id", "span")


@query(f"SELECT event_id, span FROM events JOIN {SPANS} ON event_id >= a AND event_id < b + 1")
def interval_join_halfopen(t: Load) -> DataFrame:
    return sequence.interval_join(t("events"), "event_id", spans(t), False).select("event_id", "span")


LONG_SPANS = "(SELECT user_id AS span, user_id * user_id AS a, user_id * 400 AS b FROM (SELECT DISTINCT user_id FROM events) UNION ALL SELECT -1, min(event_id), max(event_id) FROM events)"


@query(f"SELECT span, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events JOIN {LONG_SPANS} ON event_id >= a AND event_id <= b GROUP BY 1")
def interval_join_long(t: Load) -> DataFrame:
    """Spans of very different lengths, one of them over all events."""
    u = F.col("user_id")
    own = t("events").select("user_id").distinct().select(u.alias("span"), (u * u).alias("a"), (u * 400).alias("b"))
    whole = t("events").agg(F.lit(-1).cast("long").alias("span"), F.min("event_id").alias("a"), F.max("event_id").alias("b"))
    met = sequence.interval_join(t("events").select("event_id"), "event_id", own.unionByName(whole), True)
    return met.groupBy("span").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query(f"""SELECT span, count(*) AS closed, (max(b) - max(a) + 1) * 2 AS halfopen, max(grid)::BIGINT AS grid FROM
(SELECT span, a, b, unnest(range(0, (b - a) * 2 + 1)) AS j, len(range(0, b - a, 5)) AS grid FROM {SPANS}) GROUP BY 1""")
def interval_sampling(t: Load) -> DataFrame:
    a, b = F.col("a").cast("int"), F.col("b").cast("int")
    return spans(t).select("span", F.size(sequence.times_closed(a, b, 2)).cast("long").alias("closed"), F.size(sequence.times_halfopen(a, b, 2)).cast("long").alias("halfopen"), F.size(sequence.grid_times(b - a, 5)).cast("long").alias("grid"))


# ---- rates and intervals


@query(f"SELECT cond, count(*) FILTER (WHERE hit) AS hits, count(*) AS n, round(count(*) FILTER (WHERE hit)::DOUBLE / count(*), 6) AS rate FROM {TRIALS} GROUP BY 1")
def pooled_rate(t: Load) -> DataFrame:
    return rounded(rates.pooled_rate(trials(t), F.col("hit"), ["cond"]), "rate")


@query(f"SELECT cond, seed, video, round(rate, 6) AS rate FROM {CELLS}")
def macro_rate(t: Load) -> DataFrame:
    return rounded(cells(t), "rate")


@query(f"""SELECT seed, tp, fn, fp, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision FROM
(SELECT seed, count(*) FILTER (WHERE event_type = 'click' AND hit) AS tp, count(*) FILTER (WHERE event_type = 'click' AND NOT hit) AS fn, count(*) FILTER (WHERE event_type <> 'click' AND hit) AS fp FROM {TRIALS} GROUP BY 1)""")
def precision_recall(t: Load) -> DataFrame:
    return rounded(rates.precision_recall(trials(t), ["seed"], F.col("event_type") == "click", F.col("hit")), "recall", "precision")


@query(f"SELECT cond, seed, count(value) AS n, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS sd FROM {TRIALS} GROUP BY ALL")
def mean_sd(t: Load) -> DataFrame:
    return rounded(rates.mean_sd(trials(t), ["cond", "seed"], "value"), "mean", "sd")


@query(f"SELECT cond, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(ci, 6) AS ci FROM ({MACRO_CI})")
def macro_cluster_ci(t: Load) -> DataFrame:
    return rounded(rates.cluster_interval(cells(t), ["cond"], "video"), "mean", "sd", "ci")


@query(f"SELECT cond, list(round_even(r, 3) ORDER BY seed) AS rates FROM (SELECT cond, seed, avg(rate) AS r FROM {CELLS} GROUP BY ALL) GROUP BY 1")
def per_seed_macro(t: Load) -> DataFrame:
    per = cells(t).groupBy("cond", "seed").agg(F.bround(F.avg("rate"), 3).alias("r"))
    return per.groupBy("cond").agg(F.sort_array(F.collect_list(F.struct("seed", "r"))).alias("_a")).select("cond", F.col("_a.r").alias("rates"))


CURVE = f"(SELECT cond, severity, seed, count(*) FILTER (WHERE hit)::DOUBLE / count(*) AS rate FROM (SELECT *, CAST(least(5, floor(value / 20)) AS INTEGER) AS severity FROM {TRIALS}) GROUP BY ALL)"


def curve(t: Load) -> DataFrame:
    severity = F.least(F.lit(5), F.floor(F.col("value") / 20)).cast("int")
    return rates.cell_rates(trials(t).withColumn("severity", severity), ["cond", "severity", "seed"], F.col("event_type").isin("click", "view"))


CURVE = CURVE.replace("WHERE hit", "WHERE event_type IN ('click', 'view')")


@query(f"""SELECT cond, severity, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(CASE WHEN n > 1 THEN {T_SQL.format(n='n', fallback=2.0)} * sd / sqrt(n) ELSE 0 END, 6) AS ci FROM
(SELECT cond, severity, count(rate) AS n, avg(rate) AS mean, coalesce(stddev_samp(rate), 0) AS sd FROM {CURVE} GROUP BY ALL)""")
def severity_curve_ci(t: Load) -> DataFrame:
    return rounded(rates.with_interval(rates.mean_sd(curve(t), ["cond", "severity"], "rate"), 2.0), "mean", "sd", "ci")


@query(f"""SELECT cond, severity, round(m, 6) AS mean, round(m - first_value(m) OVER (PARTITION BY cond ORDER BY severity), 6) AS change FROM (SELECT cond, severity, avg(rate) AS m FROM {CURVE} GROUP BY ALL)""")
def degradation_vs_baseline(t: Load) -> DataFrame:
    from pyspark.sql import Window

    mean = curve(t).groupBy("cond", "severity").agg(F.avg("rate").alias("mean"))
    return rounded(mean.withColumn("change", F.col("mean") - F.first("mean").over(Window.partitionBy("cond").orderBy("severity"))), "mean", "change")


@query(f"""SELECT c.cond, s.severity, d.seed, coalesce(f.n, 0) AS n FROM (SELECT DISTINCT event_id % 2 AS cond FROM events) c, (SELECT unnest(range(0, 6))::INTEGER AS severity) s, (SELECT DISTINCT event_id % 5 AS seed FROM events) d
LEFT JOIN (SELECT cond, CAST(least(5, floor(value / 20)) AS INTEGER) AS severity, seed, count(*) AS n FROM {TRIALS} GROUP BY ALL) f ON f.cond = c.cond AND f.severity = s.severity AND f.seed = d.seed""")
def evaluation_grid(t: Load) -> DataFrame:
    # a grid of the declared levels of three factors, sixty cells: arrays exploded over one another
    facts = trials(t).groupBy("cond", F.least(F.lit(5), F.floor(F.col("value") / 20)).cast("int").alias("severity"), "seed").agg(F.count("*").alias("n"))
    levels = trials(t).agg(F.sort_array(F.collect_set("cond")).alias("c"), F.sort_array(F.collect_set("seed")).alias("d"))
    grid = levels.select(F.explode("c").alias("cond"), "d").select("cond", F.explode("d").alias("seed")).select("cond", "seed", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("severity"))
    return grid.join(facts, ["cond", "severity", "seed"], "left").select("cond", "severity", "seed", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(f"""WITH m AS ({MACRO_CI}), p AS (SELECT max(mean) FILTER (WHERE cond = 1) AS t, max(ci) FILTER (WHERE cond = 1) AS tc, max(mean) FILTER (WHERE cond = 0) AS c, max(ci) FILTER (WHERE cond = 0) AS cc FROM m)
SELECT round(t - c, 6) AS delta, CASE WHEN abs(t - c) > tc + cc AND t > c THEN 'better' WHEN abs(t - c) > tc + cc AND t < c THEN 'worse' WHEN abs(t - c) <= greatest(tc, cc) THEN 'same' ELSE 'unclear' END AS verdict FROM p""")
def ab_delta_verdict(t: Load) -> DataFrame:
    m = rates.cluster_interval(cells(t), ["cond"], "video")
    side = lambda k, c: F.max(F.when(F.col("cond") == k, F.col(c)))
    p = m.agg(side(1, "mean").alias("t"), side(1, "ci").alias("tc"), side(0, "mean").alias("c"), side(0, "ci").alias("cc"))
    return p.select(F.round(F.col("t") - F.col("c"), 6).alias("delta"), rates.delta_verdict(F.col("t"), F.col("tc"), F.col("c"), F.col("cc")).alias("verdict"))


@query(f"""WITH u AS (SELECT video, avg(value) FILTER (WHERE cond = 1) AS x, avg(value) FILTER (WHERE cond = 0) AS y FROM {TRIALS} GROUP BY 1)
SELECT count(*) FILTER (WHERE x > y) AS wins, count(*) AS n, round(avg(x - y), 6) AS delta FROM u WHERE x IS NOT NULL AND y IS NOT NULL""")
def paired_wins(t: Load) -> DataFrame:
    return rounded(ranking.paired_wins(trials(t), "video", "cond", 1, 0, "value"), "delta")


@query(f"""WITH r AS (SELECT video, avg(CASE WHEN event_type = 'click' THEN (value >= 25)::INT END)::DOUBLE AS a, coalesce(avg(CASE WHEN event_type = 'view' THEN (value >= 25)::INT END), 0)::DOUBLE AS b, coalesce(avg(CASE WHEN event_type = 'error' THEN (value >= 60)::INT END), 0)::DOUBLE AS c FROM {TRIALS} GROUP BY 1)
SELECT video, CASE WHEN a >= 0.6 AND b <= 0.2 AND c <= 0.2 THEN 'pass' WHEN b >= 0.4 OR c >= 0.4 THEN 'shortcut' ELSE 'ambiguous' END AS shortcut, CASE WHEN a >= 0.6 THEN 'transfers' WHEN a >= 0.3 THEN 'partial' ELSE 'weak' END AS transfer FROM r WHERE a IS NOT NULL""")
def verdict_ladders(t: Load) -> DataFrame:
    share = lambda kind, least: F.avg(F.when(F.col("event_type") == kind, (F.col("value") >= least).cast("double")))
    r = trials(t).groupBy("video").agg(share("click", 25).alias("a"), F.coalesce(share("view", 25), F.lit(0.0)).alias("b"), F.coalesce(share("error", 60), F.lit(0.0)).alias("c")).filter("a is not null")
    return r.select("video", rates.shortcut_verdict(F.col("a"), F.col("b"), F.col("c")).alias("shortcut"), rates.transfer_verdict(F.col("a")).alias("transfer"))


@query("SELECT o_orderkey, coalesce(max(l_extendedprice), 0) AS best FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'A') ON l_orderkey = o_orderkey GROUP BY 1")
def max_score_per_item(t: Load) -> DataFrame:
    found = t("lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey"), "l_extendedprice")
    return rates.max_per_item(t("orders"), found, "o_orderkey", "l_extendedprice")


@query("""SELECT video, round(r, 6) AS ratio, CASE WHEN r >= 1.3 THEN 'focused' WHEN r >= 1.0 THEN 'weak' ELSE 'elsewhere' END AS verdict FROM
(SELECT user_id AS video, avg(value) FILTER (WHERE event_type = 'click') / (avg(value) FILTER (WHERE event_type <> 'click') + 1e-8) AS r FROM events GROUP BY 1)""")
def inside_outside_ratio(t: Load) -> DataFrame:
    got = rates.inside_outside(t("events").withColumnRenamed("user_id", "video"), ["video"], "value", F.col("event_type") == "click")
    return got.select("video", F.round("ratio", 6).alias("ratio"), rates.focus_verdict(F.col("ratio")).alias("verdict"))


@query("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def medians(t: Load) -> DataFrame:
    return rounded(ordered.exact_quantiles(t("events"), ["event_type"], "value", {"median": 0.5, "p90": 0.9}), "median", "p90")


# ---- ranking


SCORES = "(SELECT source, quality = 1 AS y, CAST(n_chars AS DOUBLE) AS s FROM labels JOIN documents USING (doc_id))"
AUC = "SELECT {k} count(*) FILTER (WHERE y) AS n_pos, count(*) FILTER (WHERE NOT y) AS n_neg, round(CASE WHEN count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y) > 0 THEN (sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2.0::DOUBLE) / (count(*) FILTER (WHERE y) * count(*) FILTER (WHERE NOT y)) END, 6) AS auroc FROM (SELECT *, rank() OVER ({p} ORDER BY s) + (count(*) OVER ({q} s) - 1) / 2.0::DOUBLE AS r FROM {f}) {g}"


def scored(t: Load) -> DataFrame:
    return t("labels").join(t("documents").select("doc_id", "source", "n_chars"), "doc_id").select("source", (F.col("quality") == 1).alias("y"), F.col("n_chars").cast("double").alias("s"))


@query(AUC.format(k="", p="", q="PARTITION BY", f=SCORES, g=""))
def auroc_pooled(t: Load) -> DataFrame:
    return rounded(ranking.auroc(scored(t), "s", F.col("y")), "auroc")


@query(AUC.format(k="source,", p="PARTITION BY source", q="PARTITION BY source,", f=SCORES, g="GROUP BY source"))
def auroc_by_cluster(t: Load) -> DataFrame:
    return rounded(ranking.auroc(scored(t), "s", F.col("y"), ["source"]), "auroc")


@query(f"""WITH c AS (SELECT coalesce(quantile_cont(s, 0.9), 0.5) AS threshold FROM {SCORES} WHERE NOT y), p AS (SELECT threshold, source, CASE WHEN count(*) FILTER (WHERE y) > 0 THEN count(*) FILTER (WHERE y AND s >= threshold)::DOUBLE / count(*) FILTER (WHERE y) END AS recall,
count(*) FILTER (WHERE NOT y AND s >= threshold) AS f, count(*) FILTER (WHERE NOT y) AS n FROM {SCORES}, c GROUP BY ALL)
SELECT round(threshold, 6) AS threshold, round(avg(recall), 6) AS recall, count(recall) AS clusters, round(sum(f)::DOUBLE / sum(n), 6) AS fpr FROM p GROUP BY p.threshold""")
def quantile_threshold_rates(t: Load) -> DataFrame:
    return rounded(ranking.calibrated_rates(scored(t), "s", F.col("y"), "source"), "threshold", "recall", "fpr")


DAYS = "(SELECT event_type, CAST(event_id // 500 AS BIGINT) AS step, round(avg(value), 9) AS metric FROM events GROUP BY ALL)"


@query(f"""WITH b AS (SELECT event_type, max(metric) AS best FROM {DAYS} GROUP BY 1) SELECT d.event_type, round(best, 6) AS best, min(step) FILTER (WHERE metric = best) AS best_step, min(step) FILTER (WHERE metric >= best * 0.99) AS converged_step FROM {DAYS} d JOIN b ON b.event_type = d.event_type GROUP BY d.event_type, best""")
def argmax_and_convergence(t: Load) -> DataFrame:
    days = t("events").groupBy("event_type", F.floor(F.col("event_id") / 500).alias("step")).agg(F.round(F.avg("value"), 9).alias("metric"))
    return rounded(ranking.best_and_converged(days, ["event_type"], "step", "metric"), "best")


VOTES = """(SELECT query, avg(y) AS score FROM (SELECT q.vec_id AS query, (c.label < 5)::INT::DOUBLE AS y, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) DESC, c.vec_id) AS k
FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0) WHERE k <= 5 GROUP BY 1)"""


def votes(t: Load) -> DataFrame:
    corpus = t("embeddings").withColumn("y", F.col("label") < 5)
    return ranking.knn_votes(corpus, corpus.filter("vec_id % 50 = 0"), "vec_id", "embedding", "y")


@query(f"SELECT query, round(score, 6) AS score FROM {VOTES}")
def knn_vote(t: Load) -> DataFrame:
    return rounded(votes(t), "score")


@query(AUC.format(k="", p="", q="PARTITION BY", f=f"(SELECT label < 5 AS y, score AS s FROM {VOTES} JOIN embeddings ON vec_id = query)", g=""))
def knn_auroc(t: Load) -> DataFrame:
    both = votes(t).join(t("embeddings").select(F.col("vec_id").alias("query"), (F.col("label") < 5).alias("y")), "query")
    return rounded(ranking.auroc(both.withColumnRenamed("score", "s"), "s", F.col("y")), "auroc")


@query("SELECT vec_id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) / power(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) + 1e-8, 2), 6) AS norm2 FROM embeddings")
def l2_normalise(t: Load) -> DataFrame:
    made = vectors.with_normalised(t("embeddings").select("vec_id", "embedding"), "embedding", "v")
    return rounded(made.select("vec_id", vectors.dot(F.col("v"), F.col("v")).alias("norm2")), "norm2")


@query("SELECT a.vec_id, round(1 - list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: abs(p[1] - p[2]))) / 64 / 255, 9) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_similarity(t: Load) -> DataFrame:
    e = t("embeddings").select("vec_id", "embedding")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(after, "vec_id").select("vec_id", vectors.similarity(F.col("embedding"), F.col("other")).alias("sim")), "sim", digits=9)


@query("SELECT count(DISTINCT md5(text)) AS distinct_hashes, (SELECT sum(bit_count(xor(event_id, event_id + 1)))::BIGINT FROM events) AS bits FROM documents")
def distinct_by_hash(t: Load) -> DataFrame:
    bits = t("events").agg(F.sum(scalar.hamming(F.col("event_id"), F.col("event_id") + 1)).cast("long").alias("bits"))
    return t("documents").agg(F.countDistinct(F.md5("text")).alias("distinct_hashes")).join(F.broadcast(bits))  # one row each


FLIPS = "xor(xor(xor(('0x' || substr(md5(CAST(user_id % 40 AS VARCHAR)), 1, 15))::BIGINT, 1::BIGINT << (event_id % 62)::INT), 1::BIGINT << (event_id * 7 % 62)::INT), 1::BIGINT << (event_id * 13 % 62)::INT)"


@query(f"""WITH RECURSIVE h AS (SELECT user_id % 40 AS base, {FLIPS} AS hash, min(event_id) AS event_id FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY event_id) AS k FROM h),
r AS (SELECT base, k, event_id, hash, true AS kept, [hash] AS seen FROM o WHERE k = 1
UNION ALL SELECT o.base, o.k, o.event_id, o.hash, len(list_filter(r.seen, lambda x: bit_count(xor(x, o.hash)) <= 3)) = 0, CASE WHEN len(list_filter(r.seen, lambda x: bit_count(xor(x, o.hash)) <= 3)) = 0 THEN list_append(r.seen, o.hash) ELSE r.seen END FROM r JOIN o ON o.base = r.base AND o.k = r.k + 1)
SELECT event_id, hash FROM r WHERE kept""")
def distinct_within_radius(t: Load) -> DataFrame:
    """Hashes with a few bits flipped: of those within three bits the first stays (hashes of different users are far apart)."""
    i = F.col("event_id")
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), (i * k % 62).cast("int"))
    base = F.conv(F.substring(F.md5((F.col("user_id") % 40).cast("string")), 1, 15), 16, 10).cast("long")
    rows = t("events").select("event_id", base.bitwiseXOR(bit(1)).bitwiseXOR(bit(7)).bitwiseXOR(bit(13)).alias("hash"))
    return distinct.distinct_within(rows, "event_id", "hash", 3)


def missing_weights() -> None:
    """A loader whose weights aren't there."""


@query("SELECT vec_id, 1::INT AS used, round(list_sum(embedding::DOUBLE[]), 5) AS total, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 5) AS squares FROM embeddings")
def backbone_embeddings(t: Load) -> DataFrame:
    """Batched inference with the first backbone that loads; here the second, which takes vectors as they are."""
    made = backbones.embedded(t("embeddings"), "vec_id", "embedding", "any", {"any": [missing_weights, backbones.stored_vectors]})
    v = vectors.doubles(F.col("embedding"))
    return rounded(made.select("vec_id", "used", vectors.total(v).alias("total"), vectors.dot(v, v).alias("squares")), "total", "squares", digits=5)


POOLS = "list_transform(range(0, 16), lambda k: list_transform(range(0, 4), lambda j: embedding[j * 16 + k + 1]::DOUBLE))"


@query(f"""SELECT vec_id, round(list_sum(list_transform({POOLS}, lambda x: list_avg(x))), 6) AS means, round(list_sum(list_transform({POOLS}, lambda x: list_max(x))), 6) AS tops, len({POOLS}) * 2 AS size FROM embeddings""")
def pooled_vectors(t: Load) -> DataFrame:
    """Four vectors of 16 an embedding, pooled by mean and maximum."""
    parts = F.array(*[F.slice("embedding", 16 * j + 1, 16) for j in range(4)])
    made = t("embeddings").select("vec_id", parts.alias("parts")).select("vec_id", vectors.pooled(F.col("parts")).alias("v"))
    sums = made.select("vec_id", vectors.total(F.slice("v", 1, 16)).alias("means"), vectors.total(F.slice("v", 17, 16)).alias("tops"), F.size("v").cast("long").alias("size"))
    return rounded(sums, "means", "tops")


@query(f"""WITH u AS (SELECT event_type, video, avg(value) FILTER (WHERE cond = 1) AS x, avg(value) FILTER (WHERE cond = 0) AS y FROM {TRIALS} GROUP BY 1, 2),
d AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE x > y) AS wins, avg(x - y) AS delta, stddev_samp(x - y) / sqrt(count(*)) AS se FROM u WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
SELECT event_type, n, wins, round(delta, 6) AS delta, CASE WHEN NOT n >= 4 THEN 'withheld' WHEN delta >= 0.10 AND (wins >= 0.8 * n OR abs(delta) > 2 * se) THEN 'go' WHEN abs(delta) < 0.05 THEN 'no-go' WHEN delta <= -0.05 THEN 'worse' ELSE 'ambiguous' END AS verdict FROM d""")
def go_decisions(t: Load) -> DataFrame:
    """Whether condition 1 is worth going on with, by event type: paired means of users."""
    side = lambda k: F.avg(F.when(F.col("cond") == k, F.col("value")))
    units = trials(t).groupBy("event_type", "video").agg(side(1).alias("x"), side(0).alias("y")).filter("x is not null and y is not null")
    gap = F.col("x") - F.col("y")
    d = units.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(gap > 0).alias("wins"), F.avg(gap).alias("delta"), (F.stddev_samp(gap) / F.sqrt(F.count("*").cast("double"))).alias("se"))
    made = d.select("event_type", "n", "wins", "delta", rates.go_verdict(F.col("delta"), F.col("wins"), F.col("n"), F.abs(F.col("delta")) > 2 * F.col("se"), F.col("n") >= 4).alias("verdict"))
    return rounded(made, "delta")


# ---- sequences


@query("""WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, event_id, value AS last, k, true AS kept FROM o WHERE k = 1 UNION ALL SELECT o.user_id, o.event_id, CASE WHEN abs(o.value - r.last) >= 20 THEN o.value ELSE r.last END, o.k, abs(o.value - r.last) >= 20 FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id FROM r WHERE kept""")
def last_kept_dedup(t: Load) -> DataFrame:
    return sequence.last_kept(t("events"), "user_id", ["ts", "event_id"], "value", "event_id", 20.0)


@query("""WITH a AS (SELECT event_type, user_id, least(count(*), CAST(ceil(400.0::DOUBLE / count(*) OVER (PARTITION BY event_type)) AS BIGINT)) AS a FROM events GROUP BY 1, 2), s AS (SELECT *, sum(a) OVER (PARTITION BY event_type ORDER BY user_id) AS s FROM a)
SELECT event_type, user_id, CAST(least(400, s) - least(400, s - a) AS BIGINT) AS kept FROM s WHERE s - a < 400""")
def capped_per_group(t: Load) -> DataFrame:
    return sequence.two_level_cap(t("events").groupBy("event_type", "user_id").agg(F.count("*").alias("available")), "event_type", "user_id", "available", 400)


@query("""SELECT kind, event_id, k FROM (SELECT kind, event_id, row_number() OVER (PARTITION BY kind ORDER BY ts, event_id) AS k FROM (SELECT *, CASE WHEN event_type = 'click' AND value < 25 THEN 'miss' WHEN event_type = 'click' THEN 'hit' WHEN value >= 25 THEN 'fp' END AS kind FROM events) WHERE kind IS NOT NULL)
WHERE k <= CASE kind WHEN 'miss' THEN 9 WHEN 'hit' THEN 3 ELSE 6 END""")
def topk_per_kind(t: Load) -> DataFrame:
    click, over = F.col("event_type") == "click", F.col("value") >= 25
    kind = F.when(click & ~over, "miss").when(click, "hit").when(over, "fp")
    return sequence.top_per_kind(t("events"), kind, {"miss": 9, "hit": 3, "fp": 6}, ["ts", "event_id"]).select("kind", "event_id", F.col("k").cast("long").alias("k"))


@query("SELECT p_brand, p_partkey FROM (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS k, count(*) OVER (PARTITION BY p_brand) AS n FROM part) WHERE k % greatest(1, n // 7) = 0 OR k = n - 1")
def systematic_sample(t: Load) -> DataFrame:
    return sequence.systematic(t("part"), ["p_brand"], ["p_partkey"], 7, with_last=True).select("p_brand", "p_partkey")


@query("SELECT event_id FROM events WHERE event_id % 12 = 0")
def stride_sample(t: Load) -> DataFrame:
    return sequence.stride_sample(t("events"), "event_id", 23.976, 2).select("event_id")


@query("SELECT p_partkey, i // 6 AS page, i % 6 // 3 AS r, i % 3 AS c, format('{:05d}', i) AS serial FROM (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part)")
def page_layout(t: Load) -> DataFrame:
    return sequence.page_layout(t("part").select("p_partkey"), ["p_partkey"], 6, 3)


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 16")
def top_by_area(t: Load) -> DataFrame:
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(16)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, fell_back FROM (SELECT *, l_quantity < 30 AS fell_back, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity < 30, CASE WHEN l_quantity >= 30 THEN 0 ELSE -l_quantity END, l_linenumber, l_partkey, l_quantity) AS k FROM
(SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem)) WHERE k = 1""")
def retry_first_pass_else_best(t: Load) -> DataFrame:
    return sequence.first_pass_else_best(t("lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey"], "l_quantity", 30.0)


@query("SELECT l_linenumber, round(count(*) FILTER (WHERE l_quantity < 5)::DOUBLE / count(*), 6) AS ratio FROM lineitem GROUP BY 1")
def fallback_ratio(t: Load) -> DataFrame:
    return rounded(splits.fallback_ratio(t("lineitem"), ["l_linenumber"], F.col("l_quantity") < 5), "ratio")


@query("SELECT user_id, event_id, round(gap, 6) AS gap FROM (SELECT user_id, event_id, abs(value - 40) AS gap, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 40), value, event_id) AS k FROM events) WHERE k = 1")
def nearest_to_midpoint(t: Load) -> DataFrame:
    return rounded(sequence.nearest_to(t("events"), ["user_id"], "value", F.lit(40.0), "event_id"), "gap")


@query("SELECT source, list(doc_id ORDER BY doc_id) AS docs FROM documents GROUP BY 1")
def group_collect_in_order(t: Load) -> DataFrame:
    return t("documents").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("docs"))


# ---- pixels and boxes


CHANNELS = "(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(l_quantity * 5 AS DOUBLE) AS r, CAST(l_discount * 2500 AS DOUBLE) AS g, CAST(l_tax * 3000 AS DOUBLE) AS b FROM lineitem)"
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def channels(t: Load) -> DataFrame:
    return t("lineitem").select(*KEYS, (F.col("l_quantity") * 5).alias("r"), (F.col("l_discount") * 2500).alias("g"), (F.col("l_tax") * 3000).alias("b"))


@query(f"""SELECT l_orderkey, l_partkey, round((x0 + x1) / 2 / 640, 6) AS cx, round((x1 - x0) / 640, 6) AS w, CAST(least(greatest(0, trunc(r - CAST(round(g) AS INTEGER) / 2)), greatest(0, 255 - CAST(round(g) AS INTEGER))) AS INTEGER) AS x_start, count(*) AS n FROM
(SELECT *, r AS x0, r + g AS x1 FROM {CHANNELS}) GROUP BY ALL""")
def box_geometry(t: Load) -> DataFrame:
    x0, x1, size = F.col("r"), F.col("r") + F.col("g"), F.lit(640.0)
    box = scalar.corners_to_centre(x0, x0, x1, x1, size, size)
    made = channels(t).select("l_orderkey", "l_partkey", box[0], box[2], scalar.clamp_start(F.col("r"), F.round("g").cast("int"), F.lit(255)).alias("x_start"))
    return rounded(made, "cx", "w").groupBy("l_orderkey", "l_partkey", "cx", "w", "x_start").agg(F.count("*").alias("n"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(255 - (255 - r) * (255 - g) / 255, 6) AS screened, round(0.299 * r + 0.587 * g + 0.114 * b, 6) AS luma, round(r * (1 - b / 255) + g * (b / 255), 6) AS over,
r > 160 AND r > b + 55 AND r + g + b > 340 AS flame, CAST(trunc(least(greatest((r + g + b) / 3 * 0.55, 0), 255)) AS INTEGER) AS blob, count(*) AS n FROM {CHANNELS} GROUP BY ALL""")
def pixel_blend(t: Load) -> DataFrame:
    r, g, b = (F.col(x) for x in "rgb")
    made = channels(t).select(*KEYS, pixels.screen(r, g).alias("screened"), pixels.luma(r, g, b).alias("luma"), pixels.alpha_over(r, g, b / 255).alias("over"), pixels.is_flame_coloured(r, g, b).alias("flame"), pixels.grey_blob(r, g, b).alias("blob"))
    made = rounded(made, "screened", "luma", "over")
    return made.groupBy(*made.columns).agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT *, least(greatest(((r - b) / 255 - 0.1) / 0.9, 0), 1) AS warm, least(greatest((greatest(r, g, b) - 120) / 135, 0), 1) AS bright, least(greatest((least(r, g, b) - 200) / 55, 0), 1) AS core FROM {CHANNELS}),
m AS (SELECT l_orderkey, avg(r) AS mr, (avg(r) + avg(g) + avg(b)) / 3 AS mm FROM {CHANNELS} GROUP BY 1)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(CASE WHEN least(greatest(greatest(warm * bright, core), 0), 1) < 0.15 THEN 0 ELSE least(greatest(greatest(warm * bright, core), 0), 1) END, 6) AS alpha,
round(least(greatest(r + (mr - mm) * 0.15, 0), 255), 4) AS corrected, round(r + least(greatest((r / 255 - 0.6) / 0.4, 0), 1) * (255 - r) * 0.9, 6) AS bloomed, count(*) AS n FROM a JOIN m USING (l_orderkey) GROUP BY ALL""")
def pixel_alpha(t: Load) -> DataFrame:
    r, g, b = (F.col(x) for x in "rgb")
    c = channels(t)
    means = c.groupBy("l_orderkey").agg(F.avg("r").alias("mr"), ((F.avg("r") + F.avg("g") + F.avg("b")) / 3).alias("mm"))
    made = c.join(means, "l_orderkey").select(*KEYS, pixels.warm_alpha(r, g, b, 120, 200, 0.15, 0.1).alias("alpha"), pixels.colour_corrected(r, F.col("mr"), F.col("mm")).alias("corrected"), pixels.core_bloom(r, r, F.lit(1.0)).alias("bloomed"))
    made = rounded(rounded(made, "alpha", "bloomed"), "corrected", digits=4)
    return made.groupBy(*made.columns).agg(F.count("*").alias("n"))


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {', '.join(f'round({c} + g / 255 * ({v} / 255.0::DOUBLE * 0.35 * 60), 4) AS {c}' for c, v in zip('rb', (pixels.GLOW[0], pixels.GLOW[2]), strict=True))}, count(*) AS n FROM {CHANNELS} GROUP BY ALL")
def pixel_glow(t: Load) -> DataFrame:
    halo = F.col("g") / 255
    made = channels(t).select(*KEYS, *[pixels.bloom_glow(F.col(c), halo, float(v)).alias(c) for c, v in zip("rb", (pixels.GLOW[0], pixels.GLOW[2]), strict=True)])
    made = rounded(made, "r", "b", digits=4)
    return made.groupBy(*made.columns).agg(F.count("*").alias("n"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round((r / 255 - g / 510) * 640, 6) AS x0, round((b / 510 - g / 1020) * 480, 6) AS y0, round((r / 255 + g / 510) * 640, 6) AS x1, round((b / 510 + g / 1020) * 480, 6) AS y1, count(*) AS n FROM {CHANNELS} GROUP BY ALL""")
def box_corners(t: Load) -> DataFrame:
    """Corners of boxes given as shares of the canvas."""
    cx, cy, w, h = F.col("r") / 255, F.col("b") / 510, F.col("g") / 255, F.col("g") / 510
    made = rounded(channels(t).select(*KEYS, *scalar.centre_to_corners(cx, cy, w, h, F.lit(640), F.lit(480))), "x0", "y0", "x1", "y1")
    return made.groupBy(*made.columns).agg(F.count("*").alias("n"))


def steps(values: list[float]) -> str:
    return "CASE s " + " ".join(f"WHEN {k} THEN {v}::DOUBLE" for k, v in enumerate(values)) + " END"


@query(f"""WITH c AS (SELECT *, CAST((l_linenumber - 1) % 6 AS INTEGER) AS s FROM {CHANNELS}) SELECT s AS severity, CAST(sum(CASE WHEN s = 0 THEN trunc(r) ELSE trunc(round(least(greatest(r * {steps(pixels.LOW_LIGHT)}, 0), 255), 6)) END) AS BIGINT) AS dark,
CAST(sum(CASE WHEN s = 0 THEN trunc(r) ELSE trunc(round(least(greatest((r - 128) * {steps(pixels.CONTRAST)} + 128, 0), 255), 6)) END) AS BIGINT) AS flat,
CAST(sum(CASE WHEN s = 0 THEN trunc(r) ELSE trunc(round(least(greatest(r * (1 - {steps(pixels.GREY_MIX)}) + g * {steps(pixels.GREY_MIX)}, 0), 255), 6)) END) AS BIGINT) AS grey FROM c GROUP BY 1""")
def pixel_noise_pointwise(t: Load) -> DataFrame:
    s, r, g = F.col("severity"), F.col("r"), F.col("g")
    c = channels(t).withColumn("severity", ((F.col("l_linenumber") - 1) % 6).cast("int"))
    noise = {"dark": pixels.low_light(r, s), "flat": pixels.contrast(r, F.lit(128.0), s), "grey": pixels.grey_mix(r, g, s)}
    return c.groupBy("severity").agg(*[F.sum(x).alias(n) for n, x in noise.items()])


@query(f"SELECT l_orderkey, round(avg(abs((255 - (255 - r) * (255 - g) / 255) - r) * (b / 255)), 6) AS visibility FROM {CHANNELS} GROUP BY 1")
def placement_visibility(t: Load) -> DataFrame:
    seen = pixels.visibility(pixels.screen(F.col("r"), F.col("g")), F.col("r"), F.col("b") / 255)
    return rounded(channels(t).groupBy("l_orderkey").agg(F.avg(seen).alias("visibility")), "visibility")
