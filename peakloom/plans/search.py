"""Queries on constrained search, round trips through files and streaming."""

from __future__ import annotations

import base64
import itertools
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from peakloom.constants import AMINO_ACIDS, CARBON_MASS_DELTA, H2O_MASS, PROTON_MASS
from peakloom.functions.tokens import remove_modifications
from peakloom.operators import decode, joins, knapsack
from peakloom.plans import derive
from peakloom.sources import convert, loader, sinks
from peakloom.storage import shared_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return put


RESIDUES = {a: m for a, m in AMINO_ACIDS.items() if a != "I"}


@lru_cache(maxsize=1)
def _chart() -> knapsack.Knapsack:
    return knapsack.build(RESIDUES, max_mass=2400.0, scale=1000, max_isotope=1)


def _searched(spark, sf_dir, search: decode.Search):
    spectra = derive.ladders(spark, sf_dir)
    found = decode.decode(spectra, search, decode.FragmentEvidence(tuple(search.masses)))
    bare = lambda c: remove_modifications(F.array_join(c, ""))
    return found.join(spectra.select("id", "targets"), "id").select(
        "id", F.array_join("predictions", "").alias("prediction"), "meets_precursor", (bare("predictions") == bare("targets")).alias("correct")
    )


_NAMES = "[" + ", ".join(f"'{a}'" for a in RESIDUES) + "]"
_MASSES = "CAST([" + ", ".join(map(str, RESIDUES.values())) + "] AS DOUBLE[])"

#: The customers' ladders: v (id, t, m, n, whole), ion (id, mz), and res (j, name, mass), the residues.
_LADDERS = f"""r AS (SELECT {_NAMES} AS nm, {_MASSES} AS ms), c AS (SELECT c_custkey AS id, nm, ms, list_transform(range(1, 7 + c_custkey % 5), lambda i: 1 + (c_custkey * 7 + i * i * 3 + i * (c_custkey % 11)) % 19) AS t FROM customer, r),
    w AS (SELECT *, len(t) AS n, list_transform(t, lambda k: ms[k]) AS m FROM c), v AS (SELECT *, list_sum(m) AS whole FROM w),
    b AS (SELECT id, list_sum(m[1:k]) AS b, whole FROM v, range(1, 12) u(k) WHERE k < n),
    ion AS (SELECT id, b + {PROTON_MASS} AS mz FROM b UNION ALL SELECT id, whole - b + {H2O_MASS} + {PROTON_MASS} FROM b),
    res AS (SELECT j, nm[j] AS name, ms[j] AS mass FROM r, range(1, 20) x(j))"""


#: Every ladder spectrum is explained in full, so each search must meet the precursor wherever it ends.
@query("decode_greedy", f"""WITH RECURSIVE {_LADDERS},
    p AS (SELECT id, array_to_string(list_transform(t, lambda k: nm[k]), '') AS target, ((whole + {H2O_MASS}) / (1 + id % 3) + {PROTON_MASS} - {PROTON_MASS}) * (1 + id % 3) AS precursor FROM v),
    t AS (SELECT id, 0 AS step, CAST(0 AS DOUBLE) AS done, precursor - {H2O_MASS} AS rest, '' AS seq, precursor * 5e-5 AS allowed, precursor FROM p
          UNION ALL (WITH o AS (SELECT * FROM t WHERE step < 40 AND NOT (step > 0 AND (abs(rest) < allowed OR abs(rest - {CARBON_MASS_DELTA}) < allowed))),
              q AS (SELECT o.*, j, name, mass, done + mass AS suffix FROM o, res
                    WHERE rest - mass > -allowed OR abs(rest - mass) < allowed OR abs(rest - mass - {CARBON_MASS_DELTA}) < allowed),
              f AS (SELECT q.id, j, coalesce(sum(CASE WHEN mz BETWEEN suffix + {H2O_MASS} + {PROTON_MASS} - 0.02 AND suffix + {H2O_MASS} + {PROTON_MASS} + 0.02 THEN 1 ELSE 0 END
                        + CASE WHEN mz BETWEEN precursor - {H2O_MASS} - suffix + {PROTON_MASS} - 0.02 AND precursor - {H2O_MASS} - suffix + {PROTON_MASS} + 0.02 THEN 1 ELSE 0 END), 0) AS found
                    FROM q LEFT JOIN ion ON q.id = ion.id GROUP BY q.id, j),
              g AS (SELECT id, arg_max(j, 100 * least(found, 2) - j) AS j FROM f GROUP BY id)
              SELECT q.id, step + 1, suffix, rest - mass, name || seq, allowed, precursor FROM q JOIN g ON q.id = g.id AND q.j = g.j)),
    e AS (SELECT id, max(step) AS step FROM t GROUP BY id),
    d AS (SELECT t.id, seq, abs(rest) < allowed OR abs(rest - {CARBON_MASS_DELTA}) < allowed AS met FROM t JOIN e ON t.id = e.id AND t.step = e.step)
    SELECT id, CASE WHEN met THEN seq ELSE '' END AS prediction, met AS meets_precursor, met AND seq = target AS correct FROM d JOIN p USING (id)""")
def decode_greedy(spark, sf_dir):
    return _searched(spark, sf_dir, decode.choose(1, table=RESIDUES))


@query("decode_beam")
def decode_beam(spark, sf_dir):
    return _searched(spark, sf_dir, decode.choose(5, table=RESIDUES))


@query("decode_knapsack")
def decode_knapsack(spark, sf_dir):
    return _searched(spark, sf_dir, decode.choose(5, _chart(), table=RESIDUES))


@query("score_sequences", f"""WITH {_LADDERS},
    s AS (SELECT id, k, j, coalesce(list_sum(m[n - k + 1:n]), 0) + ms[j] AS suffix, whole + {H2O_MASS} AS precursor, CASE WHEN k < n THEN t[n - k] END AS own FROM v, range(0, 12) u(k), range(1, 20) x(j) WHERE k <= n),
    q AS (SELECT *, CASE e WHEN 0 THEN suffix + {H2O_MASS} + {PROTON_MASS} ELSE precursor - {H2O_MASS} - suffix + {PROTON_MASS} END AS place FROM s, range(0, 2) y(e)),
    f AS (SELECT q.id, k, j, own, count(mz) AS found FROM q LEFT JOIN ion ON q.id = ion.id AND mz BETWEEN place - 0.02 AND place + 0.02 GROUP BY ALL),
    g AS (SELECT id, k, coalesce(max(8.0 * least(found, 2)) FILTER (j = own), 0) - ln(sum(exp(8.0 * least(found, 2))) + 1) AS p FROM f GROUP BY id, k)
    SELECT id, round(sum(p), 6) AS log_prob FROM g GROUP BY id""")
def score_sequences(spark, sf_dir):
    scored = decode.score_sequences(derive.ladders(spark, sf_dir), "targets", decode.FragmentEvidence(tuple(RESIDUES.values())), RESIDUES)
    return scored.select("id", F.round("log_prob", 6).alias("log_prob"))


@query("knapsack_build", f"""WITH RECURSIVE r AS (SELECT {_NAMES} AS nm, {_MASSES} AS ms), c AS (SELECT DISTINCT unnest(list_transform(range(1, 7 + c_custkey % 5), lambda i: 1 + (c_custkey * 7 + i * i * 3 + i * (c_custkey % 11)) % 19)) AS k FROM customer),
    step AS (SELECT CAST(round_even(ms[k] * 10, 0) AS BIGINT) AS s FROM c, r), seed AS (SELECT s + 10 * e AS mass FROM step, range(0, 2) u(e)),
    reach AS (SELECT mass FROM seed UNION SELECT mass + s FROM reach, step WHERE mass + s <= 24000) SELECT mass FROM reach""")
def knapsack_build(spark, sf_dir):
    """Masses, in tenths of a dalton, that the residues of the customers' peptides add up to below 2,400 dalton."""
    found = derive.ladders(spark, sf_dir).select(F.explode("targets").alias("r")).distinct().collect()  # an alphabet
    chart = knapsack.build({r["r"]: RESIDUES[r["r"]] for r in found}, max_mass=2400.0, scale=10, max_isotope=1)
    words, run = spark.sparkContext.broadcast(chart.words), 64

    def rows(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                bits = np.unpackbits(words.value[k * run : (k + 1) * run].view(np.uint8), bitorder="little")
                yield pa.RecordBatch.from_arrays([pa.array(64 * run * k + np.flatnonzero(bits), pa.int64())], ["mass"])

    return spark.range(-(-len(chart.words) // run)).mapInArrow(rows, "mass long")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


def _spectra(spark, sf_dir):
    return derive.spectra(spark, sf_dir).withColumn("spectrum_id", F.col("id").cast("string")).withColumn("scan_number", F.col("id"))


_ROUND = """WITH pk AS (SELECT l_orderkey AS id, count(*) AS n_peaks, round(sum(l_extendedprice / 40), 6) AS mz_sum FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS scan_number, round(o_totalprice / 200, 6) AS precursor_mz, 1 + o_orderkey % 4 AS precursor_charge, CAST(n_peaks AS INTEGER) AS n_peaks, mz_sum FROM orders JOIN pk ON id = o_orderkey"""


def _summary(df):
    return df.select(
        F.col("scan_number").cast("bigint").alias("scan_number"), F.round("precursor_mz", 6).alias("precursor_mz"), F.col("precursor_charge").cast("bigint").alias("precursor_charge"), F.size("mz_array").alias("n_peaks"),
        F.round(F.aggregate("mz_array", F.lit(0.0), lambda a, x: a + x), 6).alias("mz_sum"),
    )


@query("mgf_roundtrip", _ROUND)
def mgf_roundtrip(spark, sf_dir):
    path = _folder(spark)
    sinks.write_mgf(_spectra(spark, sf_dir), path)
    return _summary(loader.read_mgf(spark, path, scan_from="scans"))


@query("ipc_roundtrip", _ROUND)
def ipc_roundtrip(spark, sf_dir):
    files = sinks.write_ipc(_spectra(spark, sf_dir), _folder(spark))
    return _summary(loader.read_ipc(spark, files))


@query("legacy_ipc", """SELECT o_orderkey AS scan_number, o_totalprice / 200 AS precursor_mz, o_orderkey % 4 AS precursor_charge, o_orderstatus AS modified_sequence, o_orderpriority AS sequence, CAST([o_totalprice] AS DOUBLE[]) AS mz_array FROM orders""")
def legacy_ipc(spark, sf_dir):
    """Arrow files of the old schema, migrated and read again."""
    old, new = _folder(spark), _folder(spark)
    o = derive.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("scan_number"), F.col("o_orderpriority").alias("Sequence"), F.concat(F.lit("_"), "o_orderstatus", F.lit("_")).alias("Modified sequence"),
        (F.col("o_totalprice") / 200).alias("MS/MS m/z"), (F.col("o_orderkey") % 4).alias("Charge"), F.array("o_totalprice").alias("Mass values"),
    )
    sinks.write_ipc(o, old)
    return loader.ipc.load(spark, loader.migrate_legacy(spark, old, new)).select("scan_number", "precursor_mz", "precursor_charge", "modified_sequence", "sequence", "mz_array")


@query("modified_sequence_first", """SELECT o_orderkey AS scan_number, CASE WHEN o_orderkey % 3 = 0 THEN 'PEP' || o_orderstatus END AS sequence FROM orders""")
def modified_sequence_first(spark, sf_dir):
    """The modified sequence of a CSV file stands in for the plain one, without its wrapping marks."""
    path = _folder(spark)
    modified = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("_PEP"), "o_orderstatus", F.lit("_")))
    o = derive.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_number"), F.lit("PLAIN").alias("sequence"), modified.alias("modified_sequence"))
    sinks.write_csv(o, path)
    return loader.read_csv(spark, path).select(F.col("scan_number").cast("bigint").alias("scan_number"), "sequence")


@query("csv_roundtrip", _ROUND)
def csv_roundtrip(spark, sf_dir):
    path = _folder(spark)
    sinks.write_csv(_spectra(spark, sf_dir), path)
    return _summary(loader.read_csv(spark, path))


@query("parquet_shards", _ROUND)
def parquet_shards(spark, sf_dir):
    path = _folder(spark)
    sinks.write_sharded(_spectra(spark, sf_dir), path, "demo", "train", 2000)
    return _summary(loader.load_spectra(spark, path, name="demo", partition="train"))


@query("stream_ingest", _ROUND)
def stream_ingest(spark, sf_dir):
    from peakloom.streaming.ingest import run_once

    source, path = _folder(spark), _folder(spark)
    sinks.write_sharded(_spectra(spark, sf_dir), source, "demo", "train", 4000)
    run_once(spark, source, path, lambda df: df.where("precursor_charge > 0"))
    return _summary(spark.read.parquet(path))


def _xml(kind: str):
    """Rows of spectra as lines of one XML file for each partition."""

    def mzml(scan, mz, charge, masses, heights) -> str:
        array = lambda accession, v: f'<binaryDataArray><cvParam accession="{accession}"/><cvParam accession="MS:1000523"/><binary>{packed(v)}</binary></binaryDataArray>'
        return (
            f'<spectrum id="scan={scan}"><cvParam accession="MS:1000511" value="2"/><cvParam accession="MS:1000744" value="{mz!r}"/>'
            f'<cvParam accession="MS:1000041" value="{charge}"/>{array("MS:1000514", masses)}{array("MS:1000515", heights)}</spectrum>'
        )

    def mzxml(scan, mz, charge, masses, heights) -> str:
        pairs = np.column_stack((masses, heights)).astype(">f8")
        return f'<scan num="{scan}" msLevel="2"><precursorMz precursorCharge="{charge}">{mz!r}</precursorMz><peaks precision="64">{packed(pairs)}</peaks></scan>'

    packed = lambda v: base64.b64encode(v.tobytes()).decode()
    line, head, tail = {"mzml": (mzml, "<mzML><run>", "</run></mzML>"), "mzxml": (mzxml, "<mzXML><msRun>", "</msRun></mzXML>")}[kind]

    def lists(column):
        ends = column.offsets.to_numpy()
        values = column.values.to_numpy(zero_copy_only=False).astype("<f8", copy=False)
        return [values[a:b] for a, b in itertools.pairwise(ends.tolist())]

    def lines(batches):
        yield pa.RecordBatch.from_arrays([pa.array([head])], ["value"])
        for batch in batches:
            plain = [batch.column(c).to_pylist() for c in ("scan_number", "precursor_mz", "precursor_charge")]
            made = map(line, *plain, lists(batch.column("mz_array")), lists(batch.column("intensity_array")))
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array([tail])], ["value"])

    return lines


def _from_xml(spark, sf_dir, kind, read):
    path = _folder(spark)
    rows = _spectra(spark, sf_dir).select("scan_number", "precursor_mz", "precursor_charge", "mz_array", "intensity_array")
    rows.mapInArrow(_xml(kind), "value string").write.text(path)
    return _summary(read(spark, path))


@query("mzml_read", _ROUND)
def mzml_read(spark, sf_dir):
    return _from_xml(spark, sf_dir, "mzml", loader.read_mzml)


@query("mzxml_read", _ROUND)
def mzxml_read(spark, sf_dir):
    return _from_xml(spark, sf_dir, "mzxml", loader.read_mzxml)


@query("convert_job", f"SELECT * FROM ({_ROUND}) WHERE precursor_charge <= 2")
def convert_job(spark, sf_dir):
    source, target = _folder(spark), _folder(spark)
    sinks.write_mgf(_spectra(spark, sf_dir), source)
    convert.convert(spark, source, target, "demo", "valid", max_charge=2, shard_size=2000, source_type="mgf", scan_from="scans")
    return _summary(loader.load_spectra(spark, target, name="demo", partition="valid"))


@query("earlier_prediction_files", """SELECT CAST(o_orderkey AS VARCHAR) AS spectrum_id, 'P' || CAST(o_custkey % 50 AS VARCHAR) AS prediction,
    CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 1000000, 6) END AS confidence FROM orders""")
def earlier_prediction_files(spark, sf_dir):
    """Two CSV files with other orders of columns and a further column, read as one table."""
    o = derive.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("spectrum_id"), F.concat(F.lit("P"), (F.col("o_custkey") % 50).cast("string")).alias("prediction"),
        F.when(F.col("o_orderkey") % 7 != 0, F.round(F.col("o_totalprice") / 1000000, 6)).alias("confidence"), F.col("o_orderstatus").alias("further"), F.col("o_orderkey").alias("k"),
    )
    one, two = _folder(spark), _folder(spark)
    sinks.write_csv(o.where("k % 2 = 0").drop("k"), one)
    sinks.write_csv(o.where("k % 2 = 1").select("confidence", "prediction", "spectrum_id"), two)
    return loader.read_predictions(spark, [one, two], "spectrum_id", "prediction", "confidence")


@query("predictions_by_group_csv", """SELECT o_orderkey AS id, '["A","' || o_orderstatus || '"]' AS predictions, o_orderpriority AS "group" FROM orders""")
def predictions_by_group_csv(spark, sf_dir):
    path = _folder(spark)
    o = derive.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.lit("A"), "o_orderstatus").alias("predictions"), F.col("o_orderpriority").alias("group"))
    sinks.write_predictions(o, path, by_group=True)
    return spark.read.option("header", True).option("escape", "\"").schema("id long, predictions string, `group` string").csv(path)


@query("metrics_appended", """SELECT o_orderstatus AS run, count(*) AS n, CAST(NULL AS DOUBLE) AS price FROM orders GROUP BY 1
    UNION ALL SELECT o_orderpriority, NULL, round(max(o_totalprice), 2) FROM orders GROUP BY 1""")
def metrics_appended(spark, sf_dir):
    path, o = _folder(spark), derive.table(spark, sf_dir, "orders")
    sinks.append_metrics(o.groupBy(F.col("o_orderstatus").alias("run")).agg(F.count(F.lit(1)).alias("n")), path)
    sinks.append_metrics(o.groupBy(F.col("o_orderpriority").alias("run")).agg(F.round(F.max("o_totalprice"), 2).alias("price")), path)
    rows = spark.read.option("header", True).csv(path)
    return rows.select("run", F.col("n").cast("bigint").alias("n"), F.col("price").cast("double").alias("price"))


@query("two_stage", """SELECT o_orderkey AS id, o_custkey AS first_predictions, o_totalprice AS first_log_prob, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 1 END AS second_predictions,
    CASE WHEN o_orderkey % 3 <> 0 THEN -o_totalprice END AS second_log_prob, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey + 1 END AS predictions,
    CASE WHEN o_orderkey % 3 <> 0 THEN -o_totalprice END AS log_prob FROM orders""")
def two_stage(spark, sf_dir):
    o = derive.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("predictions"), F.col("o_totalprice").alias("log_prob"))
    refined = o.where("id % 3 <> 0").select("id", (F.col("predictions") + 1).alias("predictions"), (-F.col("log_prob")).alias("log_prob"))
    return joins.two_stage(o, refined, "id")
