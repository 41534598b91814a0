"""Queries on tables: schemas, filters, samples, splits, joins, sets, shards."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from peakloom.constants import AMINO_ACIDS
from peakloom.functions import tokens
from peakloom.operators import filters, joins, knapsack, ordered, sampling, schema, substrings
from peakloom.plans import derive, sql
from peakloom.plans.derive import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return put


_RUNS = """rn AS (SELECT event_id, 'run_' || CAST(user_id % 5 AS VARCHAR) AS run, value AS retention_time,
    CASE event_id % 3 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN 'controller=0 scan=' || CAST(event_id AS VARCHAR) ELSE 'none' END AS label FROM events)"""


@query("parse_scan_number", rf"""WITH {_RUNS} SELECT event_id, coalesce(CASE WHEN regexp_matches(label, '^\d+$') THEN TRY_CAST(label AS BIGINT) END,
    TRY_CAST(nullif(regexp_extract(label, 'scan=(\d+)', 1), '') AS BIGINT), -event_id) AS scan FROM rn""")
def parse_scan_number(spark, sf_dir):
    return derive.runs(spark, sf_dir).select("event_id", tokens.scan_number(F.col("label"), -F.col("event_id")).alias("scan"))


@query("spectrum_ids", f"WITH {_RUNS} SELECT event_id, run AS experiment_name, run || ':' || CAST(event_id AS VARCHAR) AS spectrum_id FROM rn")
def spectrum_ids(spark, sf_dir):
    named = schema.identified(derive.runs(spark, sf_dir), F.col("run"), F.col("event_id"))
    return named.select("event_id", "experiment_name", "spectrum_id")


@query("rename_cast", "SELECT event_id AS scan_number, CAST(user_id AS BIGINT) AS precursor_charge, CAST(value AS DOUBLE) AS retention_time FROM events")
def rename_cast(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("int").alias("user_id"), F.col("value").cast("string").alias("value"))
    return schema.coerced(schema.renamed(df, {"event_id": "scan_number", "user_id": "precursor_charge", "value": "retention_time", "absent": "x"}))


@query("annotation_check", f"""WITH {sql.STRINGS} SELECT count(*) AS n_rows, count(*) FILTER (peptide IS NULL OR peptide = '') AS n_unannotated,
    count(*) FILTER (peptide IS NULL OR peptide = '') = 0 AS all_annotated, CAST(sum(id % 4) AS BIGINT) AS charge_sum FROM st""")
def annotation_check(spark, sf_dir):
    return schema.annotation_state(derive.peptide_strings(spark, sf_dir).withColumn("z", F.col("id") % 4), "peptide", "z")


@query("prediction_ids", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS prediction_id FROM orders")
def prediction_ids(spark, sf_dir):
    return schema.with_prediction_ids(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")])


@query("row_lookup", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, o_custkey FROM r WHERE i = 100")
def row_lookup(spark, sf_dir):
    """The orders' row of that index in the file, which is in the order of the keys; footers tell which file to read."""
    from peakloom.sources.loader import row_at

    return row_at(spark, f"{sf_dir}/orders.parquet", 100).select("o_orderkey", "o_custkey")


@query("first_seen_types", """SELECT o_orderkey AS k, CAST(o_custkey AS INTEGER) AS v, CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END AS note,
    CAST(o_custkey % 7 AS VARCHAR) AS p FROM orders""")
def first_seen_types(spark, sf_dir):
    """Shards that have a column as int, as bigint and as text, load in the types of the first."""
    from peakloom.sources.loader import read_parquet
    from peakloom.storage import folder

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("v"), (F.col("o_custkey") % 7).cast("string").alias("p"), F.col("o_orderstatus").alias("note"))
    paths = [folder(spark, "shards") for _ in range(3)]
    o.where("k % 2 = 0").select("k", F.col("v").cast("int").alias("v"), "p").write.parquet(paths[0])
    o.where("k % 4 = 1").select("note", F.col("v").cast("bigint").alias("v"), F.col("p").cast("int").alias("p"), "k").write.parquet(paths[1])
    o.where("k % 4 = 3").select("note", F.col("v").cast("string").alias("v"), "p", F.col("k").cast("int").alias("k")).write.parquet(paths[2])
    return read_parquet(spark, paths).select("k", "v", "note", "p")


@query("row_count", "SELECT count(*) AS n FROM lineitem")
def row_count(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@query("index_columns", "SELECT o_orderkey AS id, o_custkey AS scan_number FROM orders")
def index_columns(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("scan_number"), F.col("o_orderstatus").alias("status"))
    return schema.index_columns(df)


@query("filter_rows", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_custkey % 2 = 0")
def filter_rows(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    kept = filters.filter_rows(filters.filter_rows(df, F.col("o_totalprice") > 500), "o_custkey % 2 = 0")
    return filters.filter_rows(kept, lambda row: row["o_totalprice"] > 1000).select("o_orderkey")


@query("check_values", "SELECT count(*) AS n_outside FROM orders WHERE o_totalprice < 0 OR o_totalprice > 400000")
def check_values(spark, sf_dir):
    return filters.outside(table(spark, sf_dir, "orders"), "o_totalprice", 0, 400000).agg(F.count(F.lit(1)).alias("n_outside"))


@query("charge_filter", f"WITH {sql.SPECTRA} SELECT id, precursor_charge FROM sp WHERE precursor_charge > 0 AND precursor_charge <= 3")
def charge_filter(spark, sf_dir):
    return filters.by_charge(derive.spectra(spark, sf_dir), 3).select("id", "precursor_charge")


@query("vocab_filter", f"WITH {sql.PSM} SELECT id FROM psm WHERE NOT list_has_any(list_transform(ti, lambda k: nm[k]), ['W', 'Y'])")
def vocab_filter(spark, sf_dir):
    return filters.by_vocabulary(derive.psm(spark, sf_dir), "targets", [a for a in AMINO_ACIDS if a not in "WY"]).select("id")


@query("novel_at_threshold", f"WITH {sql.PSM_X} SELECT count(*) FILTER (confidence >= 0.7) AS n_confident, count(*) FILTER (confidence >= 0.7 AND id % 8 = 0) AS n_novel FROM px")
def novel_at_threshold(spark, sf_dir):
    sure = F.col("confidence") >= 0.7
    return derive.psm_x(spark, sf_dir).agg(F.count_if(sure).alias("n_confident"), F.count_if(sure & (F.col("id") % 8 == 0)).alias("n_novel"))


@query("unique_sequences", f"WITH {sql.PSM} SELECT DISTINCT array_to_string(list_transform(ti, lambda k: nm[k]), '') AS sequence FROM psm")
def unique_sequences(spark, sf_dir):
    return derive.psm(spark, sf_dir).select(F.array_join("targets", "").alias("sequence")).distinct()


@query("vocabulary", f"WITH {sql.STRINGS} SELECT DISTINCT unnest({sql.TOKENS % 'peptide'}) AS token FROM (SELECT DISTINCT peptide FROM st)")
def vocabulary(spark, sf_dir):
    peptides = derive.peptide_strings(spark, sf_dir).select("peptide").distinct()
    return peptides.select(F.explode(tokens.tokenize(F.col("peptide"))).alias("token")).distinct()


@query("group_map", f"WITH x AS (SELECT 1){sql.GROUPS} SELECT o_orderkey AS id, coalesce(grp, 'no_group') AS \"group\" FROM orders LEFT JOIN gm ON id = o_orderkey")
def group_map(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return joins.with_group(ids, derive.group_map(spark, sf_dir), "id")


@query("group_counts", f"WITH x AS (SELECT 1){sql.GROUPS} SELECT coalesce(grp, 'no_group') AS \"group\", count(*) AS n FROM orders LEFT JOIN gm ON id = o_orderkey GROUP BY ALL")
def group_counts(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return joins.with_group(ids, derive.group_map(spark, sf_dir), "id").groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query("dedup_first", "SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) = 1")
def dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    return ordered.first_of(rows, ["l_orderkey"], [F.col("l_partkey"), F.col("l_suppkey")])


@query("predictions_join", f"WITH {sql.PSM_X} SELECT o_orderkey AS id, confidence FROM orders LEFT JOIN px ON o_orderkey = id AND id % 7 <> 0")
def predictions_join(spark, sf_dir):
    index = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return joins.with_predictions(index, derive.psm_x(spark, sf_dir).where("id % 7 <> 0").select("id", "confidence"), "id")


@query("refinement_lookup", """WITH p AS (SELECT l_orderkey AS id, 'p' || CAST(l_partkey AS VARCHAR) AS pred, l_extendedprice AS lp, l_partkey * 100000 + l_suppkey AS seq FROM lineitem WHERE l_orderkey % 3 <> 0
        QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey * 100000 + l_suppkey DESC, l_extendedprice DESC) = 1)
    SELECT o_orderkey AS id, coalesce(pred, '') AS input_predictions FROM orders LEFT JOIN p ON id = o_orderkey""")
def refinement_lookup(spark, sf_dir):
    spectra = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    seq = F.col("l_partkey") * 100000 + F.col("l_suppkey")
    earlier = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("pred"), seq.alias("seq"), F.col("l_extendedprice").alias("lp")
    )
    return joins.earlier_predictions(spectra, earlier, "id", "seq", "pred", "lp").select("id", "input_predictions")


@query("suffixed_join", "SELECT o.o_orderkey AS scan_number, o.o_custkey AS value_x, coalesce(l.n, 0) AS value_y FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def suffixed_join(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_number"), F.col("o_custkey").alias("value"))
    b = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("scan_number")).agg(F.count(F.lit(1)).alias("value"))
    return joins.suffixed(a, b, "scan_number").fillna(0, ["value_y"])


@query("set_filter", "SELECT count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem)) AS n_in, count(*) FILTER (o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS n_out FROM orders")
def set_filter(spark, sf_dir):
    o, keys = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    sides = joins.in_set(o, keys, "o_orderkey").select(F.lit(1).alias("i")).unionByName(joins.not_in_set(o, keys, "o_orderkey").select(F.lit(0).alias("i")))
    return sides.agg(F.count_if(F.col("i") == 1).alias("n_in"), F.count_if(F.col("i") == 0).alias("n_out"))


@query("moving_average", """WITH e AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events),
    b AS (SELECT *, i // 1000 AS block, i % 1000 AS j FROM e),
    s AS (SELECT *, sum(0.01 * value * pow(0.99, -j)) OVER (PARTITION BY block ORDER BY j) AS s FROM b),
    r AS (SELECT block, max(j) + 1 AS n, max_by(s * pow(0.99, j), j) AS part FROM s GROUP BY block),
    c AS (SELECT x.block, (SELECT coalesce(sum(y.part * pow(0.99, 1000 * (x.block - y.block - 1))), 0) FROM r y WHERE y.block < x.block) AS carried FROM r x)
    SELECT event_id, round(s * pow(0.99, j) + pow(0.99, j + 1) * carried + pow(0.99, i + 1) * (SELECT value FROM e WHERE i = 0), 6) AS average FROM s JOIN c USING (block)""")
def moving_average(spark, sf_dir):
    rows = ordered.moving_average(table(spark, sf_dir, "events").select("event_id", "value"), [F.col("event_id")], "value")
    return rows.select("event_id", F.round("average", 6).alias("average"))


@query("split_by_peptide", f"""WITH {sql.PSM}, s AS (SELECT id, replace(array_to_string(list_transform(ti, lambda k: nm[k]), ''), 'I', 'L') AS bare FROM psm)
    SELECT bare, CASE WHEN {sql.share("CAST('0x' || substr(md5(bare), 1, 7) AS BIGINT)")} < 100000 THEN 'valid' ELSE 'train' END AS split, count(*) AS n FROM s GROUP BY ALL""")
def split_by_peptide(spark, sf_dir):
    """How often each peptide occurs, and on which side it falls."""
    bare = tokens.remove_modifications(F.array_join("targets", ""))
    rows = sampling.split_by_group(derive.psm(spark, sf_dir).withColumn("bare", bare), F.col("bare"), 0.1)
    return rows.groupBy("bare", "split").agg(F.count(F.lit(1)).alias("n"))


@query("hash_sample", f"SELECT o_orderkey FROM orders WHERE {sql.share('o_orderkey')} < 250000")
def hash_sample(spark, sf_dir):
    return sampling.sample_by_key(table(spark, sf_dir, "orders"), F.col("o_orderkey"), 0.25).select("o_orderkey")


def _feistel_sql(rounds: int = 6, seed: int = 42) -> tuple[str, str]:
    """The steps of the network over w (i, x, n rows, half the bits h) and the name of the last, which has halves b and a."""
    keys = [(seed * 7919 + r * 104729 + 1) % 2147483647 for r in range(rounds)]
    steps, left, right = "", "x >> h", "x & ((1 << h) - 1)"
    for r, k in enumerate(keys):
        source = "w" if r == 0 else f"f{r - 1}"
        l, x = (left, right) if r == 0 else ("b", "a")
        steps += f""", f{r} AS (SELECT i, n, h, {x} AS b, xor({l}, ((({x}) * 48271 + {k}) % 2147483647 * 69621 % 2147483647) & ((1 << h) - 1)) AS a FROM {source})"""
    return steps.replace(", f0", "f0", 1), f"f{rounds - 1}"


_STEPS, _LAST = _feistel_sql()


@query("shuffle", f"""WITH RECURSIVE z AS (SELECT count(*) AS n, greatest(1, (CAST(floor(log2(greatest(1, count(*) - 1))) AS INTEGER) + 2) // 2) AS h FROM orders),
    o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
    t AS (SELECT i, CAST(i AS BIGINT) AS x, CAST(0 AS BIGINT) AS turn, n, h FROM o, z
          UNION ALL (WITH w AS (SELECT i, x, n, h FROM t WHERE turn = 0 OR x >= n), {_STEPS} SELECT i, (b << h) | a, 1, n, h FROM {_LAST})),
    p AS (SELECT i, x FROM t WHERE turn = 1 AND x < n),
    s AS (SELECT o_orderpriority AS name, count(*) AS c, row_number() OVER (ORDER BY o_orderpriority) - 1 AS shard, sum(count(*)) OVER (ORDER BY o_orderpriority) - count(*) AS begin FROM orders GROUP BY 1)
    SELECT o_orderkey, shard, CAST(x - begin AS BIGINT) AS place FROM p JOIN o USING (i) JOIN s ON x >= begin AND x < begin + c""")
def shuffle(spark, sf_dir):
    """All orders in one random order, in shards of the sizes that the priorities have."""
    o = table(spark, sf_dir, "orders")
    sizes = [r["count"] for r in o.groupBy("o_orderpriority").count().orderBy("o_orderpriority").collect()]
    return sampling.shuffled(o.select("o_orderkey"), sizes, order=[F.col("o_orderkey")])


@query("shuffle_buffer", "SELECT o_orderkey, o_custkey FROM orders")
def shuffle_buffer(spark, sf_dir):
    return sampling.buffered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), 1000)


_HASH = "((o_orderkey * 48271 + 42) % 2147483647 * 69621) % 2147483647"


@query("sample_exact", f"SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY {_HASH}, o_orderkey) <= (SELECT floor(count(*) * 0.2) FROM orders)")
def sample_exact(spark, sf_dir):
    return sampling.sample_exact(table(spark, sf_dir, "orders").select("o_orderkey"), 0.2, F.col("o_orderkey"))


@query("shard_assign", "WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders) SELECT o_orderkey, CAST(i // 1000 AS BIGINT) AS shard, i % 1000 AS place FROM r")
def shard_assign(spark, sf_dir):
    rows = sampling.sharded(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], 1000)
    return rows.select("o_orderkey", F.col("shard").cast("bigint").alias("shard"), F.col("place").cast("bigint").alias("place"))


@query("union_relaxed", "SELECT o_orderkey AS k, CAST(o_custkey AS DOUBLE) AS v, NULL::VARCHAR AS note FROM orders UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM supplier")
def union_relaxed(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast("int").alias("v"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.col("s_acctbal").alias("v"), F.lit("s").alias("note"))
    return schema.union_relaxed(a, b)


@query("venn_regions", f"""WITH {sql.PSM_X}, a AS (SELECT DISTINCT array_to_string(ti, '.') AS p FROM px WHERE id % 2 = 0), b AS (SELECT DISTINCT array_to_string(pi, '.') AS p FROM px WHERE id % 3 <> 0)
    SELECT count(*) FILTER (b.p IS NULL) AS left_only, count(*) FILTER (a.p IS NOT NULL AND b.p IS NOT NULL) AS both, count(*) FILTER (a.p IS NULL) AS right_only FROM a FULL JOIN b ON a.p = b.p""")
def venn_regions(spark, sf_dir):
    px = derive.psm_x(spark, sf_dir)
    text = lambda c: F.array_join(c, ".").alias("p")
    return schema.regions(px.where("id % 2 = 0").select(text("targets")), px.where("id % 3 <> 0").select(text("predictions")), "p")


@query("token_sets", f"""WITH {sql.PSM}, a AS (SELECT DISTINCT unnest(ti) AS t FROM psm WHERE id % 2 = 0), b AS (SELECT DISTINCT unnest(pi_full) AS t FROM psm WHERE id % 2 = 1), r4 AS (SELECT {sql.NAMES} AS k)
    SELECT k[t] AS token FROM (SELECT t FROM a UNION SELECT t FROM b), r4 WHERE k[t] NOT IN ('A', 'C', 'D')""")
def token_sets(spark, sf_dir):
    p = derive.psm(spark, sf_dir)
    both = p.where("id % 2 = 0").select(F.explode("targets").alias("token")).union(p.where("id % 2 = 1").select(F.explode("predictions").alias("token")))
    return both.distinct().subtract(spark.createDataFrame([("A",), ("C",), ("D",)], "token string"))


@query("top_n_beams", """WITH b AS (SELECT l_orderkey AS id, l_partkey, l_suppkey, l_quantity > 25 AS meets, l_extendedprice AS lp, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_quantity > 25 THEN 0 ELSE 1 END, l_extendedprice DESC, l_partkey, l_suppkey) AS rank FROM lineitem)
    SELECT id, l_partkey, l_suppkey, rank::INTEGER AS rank FROM b WHERE rank <= 3""")
def top_n_beams(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_suppkey", (F.col("l_quantity") > 25).alias("meets"), F.col("l_extendedprice").alias("lp"))
    best = ordered.top_n(rows, ["id"], [F.col("meets").desc(), F.col("lp").desc(), F.col("l_partkey"), F.col("l_suppkey")], 3)
    return best.select("id", "l_partkey", "l_suppkey", "rank")


@query("padded_beams", "WITH b AS (SELECT l_orderkey AS id, least(count(*), 4) AS n FROM lineitem GROUP BY l_orderkey) SELECT id, 4 AS n_beams, CAST(4 - n AS INTEGER) AS n_empty FROM b")
def padded_beams(spark, sf_dir):
    beam = F.struct(F.col("l_extendedprice").alias("lp"), F.col("l_partkey").alias("seq"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(beam), False).alias("b"))
    empty = F.struct(F.lit(float("-inf")).alias("lp"), F.lit(None).cast("bigint").alias("seq"))
    out = ordered.padded_beams(F.col("b"), 4, empty)
    return rows.select("id", F.size(out).alias("n_beams"), F.size(F.filter(out, lambda x: x["seq"].isNull())).alias("n_empty"))


@query("peptides_per_protein", "SELECT 'P' || CAST(l_suppkey AS VARCHAR) AS protein, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY ALL")
def peptides_per_protein(spark, sf_dir):
    label = F.concat(F.lit("sp|P"), F.col("l_suppkey").cast("string"), F.lit("|NAME;tr|X|Y"))
    rows = table(spark, sf_dir, "lineitem").select(tokens.accession(label).alias("protein"), "l_partkey")
    return rows.groupBy("protein").agg(F.countDistinct("l_partkey").alias("n"))


@query("band_join_ppm", """WITH a AS (SELECT o_orderkey AS ka, o_totalprice AS va FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_orderkey AS kb, o_totalprice AS vb FROM orders WHERE o_orderstatus = 'P')
    SELECT ka, kb FROM a JOIN b ON abs(va - vb) < 0.5""")
def band_join_ppm(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("ka"), F.col("o_totalprice").alias("va"))
    b = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("kb"), F.col("o_totalprice").alias("vb"))
    return joins.band_join(a, b, "va", "vb", 0.5).select("ka", "kb")


_FEASIBLE = """WITH m AS (SELECT DISTINCT CAST(round_even(o_totalprice * 100, 0) AS BIGINT) AS mass FROM orders), w AS (SELECT o_orderkey AS id, CAST(round_even((o_totalprice - 3) * 100, 0) AS BIGINT) AS lo, CAST(round_even((o_totalprice + 3) * 100, 0) AS BIGINT) AS hi FROM orders)
    SELECT id, count(*) AS n, min(mass) AS low, max(mass) AS high FROM w JOIN m ON mass > lo AND mass < hi GROUP BY id"""


#: The second name is kept for those who call it; both look up every order.
@query("feasible_masses", _FEASIBLE)
@query("feasible_masses_all", _FEASIBLE)
def feasible_masses(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    all_masses = o.select(F.bround(F.col("o_totalprice") * 100, 0).cast("bigint").alias("mass")).distinct()
    hits = knapsack.feasible(all_masses, o.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("target")), "target", 3.0, 100)
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("mass").alias("low"), F.max("mass").alias("high"))


@query("file_begins", f"WITH {_RUNS}, c AS (SELECT run, count(*) AS rows FROM rn GROUP BY run) SELECT run, rows, CAST(coalesce(sum(rows) OVER (ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin FROM c")
def file_begins(spark, sf_dir):
    from peakloom.sources.loader import file_begins

    return file_begins(derive.runs(spark, sf_dir), "run")


@query("split_manifest", """SELECT DISTINCT o_orderpriority AS sequence, CASE WHEN o_orderpriority < '3' THEN 'valid' ELSE 'train' END AS split FROM orders""")
def split_manifest(spark, sf_dir):
    from peakloom.sources.sinks import write_split_manifest
    from peakloom.storage import shared_dir

    path = f"{shared_dir(spark)}/splits-{uuid.uuid4().hex}"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sequence"), F.when(F.col("o_orderpriority") < "3", "valid").otherwise("train").alias("split"))
    write_split_manifest(o, path, "sequence")
    return spark.read.option("header", True).csv(path)


@query("metadata_columns", "SELECT o_orderkey, o_orderstatus, round(o_totalprice / 200, 6) AS precursor_mz FROM orders")
def metadata_columns(spark, sf_dir):
    return schema.with_metadata(table(spark, sf_dir, "orders"), {"precursor_mz": F.round(F.col("o_totalprice") / 200, 6)}, ("o_orderkey", "o_orderstatus"))


@query("padded_batches", """WITH s AS (SELECT l_orderkey AS id, l_orderkey // 32 AS batch, CAST(count(*) AS INTEGER) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY ALL)
    SELECT id, CAST(max(n) OVER (PARTITION BY batch) AS INTEGER) AS width, CAST(max(n) OVER (PARTITION BY batch) - n AS INTEGER) AS n_padding, round(total, 6) AS total FROM s""")
def padded_batches(spark, sf_dir):
    from peakloom.operators.batches import padded

    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.col("l_quantity").cast("double")).alias("values"))
    done = padded(rows.withColumn("batch", F.floor(F.col("id") / 32)), "values", "batch")
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x)
    return done.select("id", F.size("values").alias("width"), F.size(F.filter("mask", lambda m: m)).alias("n_padding"), F.round(total, 6).alias("total"))


@query("union_strict", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def union_strict(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    part = lambda status: o.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey")
    return schema.union_strict(part("F"), part("O"))


@query("warmup_factor", "SELECT event_id, round(0.5 * (1 + cos(pi() * event_id / 200000)) * least(1.0, event_id / 1000), 9) AS factor FROM events")
def warmup_factor(spark, sf_dir):
    """The learning rate's factor at each event, taken as a step of training."""
    from peakloom.functions.numeric import warmup_factor

    return table(spark, sf_dir, "events").select("event_id", F.round(warmup_factor(F.col("event_id"), 1000, 200000), 9).alias("factor"))


@query("sinusoids", "SELECT event_id, CAST(i AS INTEGER) AS i, round(CASE i % 2 WHEN 0 THEN sin(event_id * exp(-ln(10000.0) * 2 * (i // 2) / 8)) ELSE cos(event_id * exp(-ln(10000.0) * 2 * (i // 2) / 8)) END, 6) AS v FROM events, range(0, 8) u(i)")
def sinusoids(spark, sf_dir):
    """The encoding of each event's position."""
    from peakloom.functions.numeric import sinusoids

    found = table(spark, sf_dir, "events").select("event_id", F.posexplode(sinusoids(F.col("event_id"), 8)).alias("i", "v"))
    return found.select("event_id", "i", F.round("v", 6).alias("v"))


@query("legacy_columns", "SELECT o_orderkey AS precursor_mz, trim(o_orderstatus, '_') AS modified_sequence FROM orders")
def legacy_columns(spark, sf_dir):
    from peakloom.sources.loader import from_legacy

    df = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("MS/MS m/z"), F.concat(F.lit("_"), "o_orderstatus", F.lit("_")).alias("Modified sequence"))
    return from_legacy(df).select("precursor_mz", "modified_sequence")


@query("peptide_in_reference", """WITH w AS (SELECT DISTINCT lower(split_part(text, ' ', 3)) AS word FROM benchmark) SELECT word, count(*) AS n_items FROM w JOIN benchmark ON contains(lower(text), word) WHERE word <> '' GROUP BY word""")
def peptide_in_reference(spark, sf_dir):
    """In how many of the benchmark's items each word occurs, by the seed index."""
    b = table(spark, sf_dir, "benchmark")
    words = b.select(F.lower(F.split_part("text", F.lit(" "), F.lit(3))).alias("word"))
    hits = substrings.occurrences(words, "word", b.select("item_id", F.lower("text").alias("text")), "item_id", "text", 4)
    return hits.groupBy(F.col("string").alias("word")).agg(F.countDistinct("id").alias("n_items"))
