"""Queries on peptide strings, tokens, masses and peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakloom.constants import RESIDUE_REMAPPING, TOKEN_PATTERN
from peakloom.functions import masses, numeric, peaks, tokens
from peakloom.plans import derive, sql
from peakloom.plans.derive import as_text, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, text: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return put


def text_sql(expr: str, digits: int = 6) -> str:
    return f"array_to_string(list_transform({expr}, lambda v: CAST(CAST(round(v * {10**digits}) AS BIGINT) AS VARCHAR)), ',')"


_TK = sql.TOKENS % "peptide"


@query("tokenize", f"WITH {sql.STRINGS} SELECT id, coalesce(array_to_string({_TK}, '|'), '') AS tokens, coalesce(len({_TK}), 0)::INTEGER AS n FROM st")
def tokenize(spark, sf_dir):
    t = tokens.tokenize(F.col("peptide"))
    return derive.peptide_strings(spark, sf_dir).select("id", F.array_join(t, "|").alias("tokens"), F.size(t).alias("n"))


@query("detokenize", f"WITH {sql.STRINGS} SELECT id, coalesce(array_to_string({_TK}, ''), '') AS peptide FROM st")
def detokenize(spark, sf_dir):
    return derive.peptide_strings(spark, sf_dir).select("id", tokens.detokenize(tokens.tokenize(F.col("peptide"))).alias("peptide"))


@query("detokenize_proforma", f"""WITH {sql.STRINGS}, x AS (SELECT id, {_TK} AS t FROM st)
    SELECT id, coalesce(CASE WHEN len(t) > 1 AND NOT regexp_matches(t[1], '^[A-Za-z]') THEN t[1] || '-' || array_to_string(t[2:], '') ELSE array_to_string(t, '') END, '') AS proforma FROM x""")
def detokenize_proforma(spark, sf_dir):
    return derive.peptide_strings(spark, sf_dir).select("id", tokens.to_proforma(tokens.tokenize(F.col("peptide"))).alias("proforma"))


@query("tokens_listed", f"WITH {sql.STRINGS} SELECT id, coalesce(array_to_string({_TK}, ', '), '') AS tokens FROM st")
def tokens_listed(spark, sf_dir):
    return derive.peptide_strings(spark, sf_dir).select("id", tokens.tokens_listed(tokens.tokenize(F.col("peptide"))).alias("tokens"))


@query("sanitise", rf"WITH {sql.STRINGS} SELECT id, regexp_replace(regexp_replace(peptide, '^_(.*)_$', '\1'), '^\.(.*)\.$', '\1') AS peptide FROM st")
def sanitise(spark, sf_dir):
    return derive.peptide_strings(spark, sf_dir).select("id", tokens.sanitise(F.col("peptide")).alias("peptide"))


@query("remove_modifications", f"WITH {sql.STRINGS} SELECT id, replace(regexp_replace(replace(peptide, 'UNIMOD', ''), '[^A-Z]', '', 'g'), 'I', 'L') AS bare FROM st")
def remove_modifications(spark, sf_dir):
    return derive.peptide_strings(spark, sf_dir).select("id", tokens.remove_modifications(F.col("peptide")).alias("bare"))


@query("remap_residues", f"WITH {sql.STRINGS} SELECT id, coalesce(array_to_string(list_transform({_TK}, lambda t: {sql.REMAP}), '|'), '') AS tokens FROM st")
def remap_residues(spark, sf_dir):
    t = tokens.remap(tokens.tokenize(F.col("peptide")), RESIDUE_REMAPPING)
    return derive.peptide_strings(spark, sf_dir).select("id", F.array_join(t, "|").alias("tokens"))


@query("clean_predictions", f"WITH {sql.STRINGS}, r2 AS (SELECT {sql.NAMES} AS k) SELECT id, coalesce(array_to_string(list_transform({_TK}, lambda t: CASE WHEN list_contains(k, t) THEN t ELSE '[PAD]' END), ', '), '') AS tokens FROM st, r2")
def clean_predictions(spark, sf_dir):
    t = tokens.tokenize(F.col("peptide"))
    return derive.peptide_strings(spark, sf_dir).select("id", tokens.clean_tokens(t, derive.RESIDUES).alias("tokens"))


@query("mod_counts", rf"""WITH {sql.STRINGS}, t AS (SELECT id, array_to_string(list_transform({_TK}, lambda t: {sql.REMAP}), '') AS p FROM st),
    m AS (SELECT id, unnest(regexp_extract_all(p, '\[UNIMOD:\d+\]')) AS modification FROM t)
    SELECT modification, count(*) AS n, count(DISTINCT id) AS n_peptides FROM m GROUP BY modification""")
def mod_counts(spark, sf_dir):
    t = F.array_join(tokens.remap(tokens.tokenize(F.col("peptide")), RESIDUE_REMAPPING), "")
    rows = derive.peptide_strings(spark, sf_dir).select("id", F.explode(tokens.modifications(t)).alias("modification"))
    return rows.groupBy("modification").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_peptides"))


_IX = "list_transform({x}, lambda k: k + 2)"


@query("encode", f"WITH {sql.PSM} SELECT id, array_to_string(list_concat({_IX.format(x='ti')}, [2]), ',') AS idx FROM psm")
def encode(spark, sf_dir):
    v = tokens.vocabulary()
    return derive.psm(spark, sf_dir).select("id", F.array_join(tokens.encode(F.col("targets"), v, add_eos=True).cast("array<string>"), ",").alias("idx"))


@query("encode_target", f"WITH {sql.PSM} SELECT id, array_to_string(list_concat(list_reverse({_IX.format(x='ti')}), [2]), ',') AS idx FROM psm")
def encode_target(spark, sf_dir):
    v = tokens.vocabulary()
    return derive.psm(spark, sf_dir).select("id", F.array_join(tokens.encode_target(F.col("targets"), v).cast("array<string>"), ",").alias("idx"))


@query("encode_padded", f"WITH {sql.PSM} SELECT id, array_to_string(list_concat({_IX.format(x='ti')}, list_transform(range(len(ti), 40), lambda k: 0)), ',') AS idx FROM psm")
def encode_padded(spark, sf_dir):
    v = tokens.vocabulary()
    return derive.psm(spark, sf_dir).select("id", F.array_join(tokens.encode_fixed(F.col("targets"), v).cast("array<string>"), ",").alias("idx"))


@query("decode", f"WITH {sql.PSM} SELECT id, array_to_string(list_reverse(list_transform(ti, lambda k: nm[k])), '') AS peptide FROM psm")
def decode(spark, sf_dir):
    v = tokens.vocabulary()
    idx = tokens.encode(F.col("targets"), v, add_eos=True, pad_length=20)
    return derive.psm(spark, sf_dir).select("id", F.array_join(tokens.decode(idx, v, reverse=True), "").alias("peptide"))


@query("sequence_mass", f"WITH {sql.PSM_X} SELECT id, round(list_sum(list_transform(ti, lambda k: ms[k])) + 18.0106, 6) AS mass, round(mz_theory, 8) AS mz FROM px")
def sequence_mass(spark, sf_dir):
    return derive.psm_x(spark, sf_dir).select("id", F.round(masses.sequence_mass(F.col("targets")), 6).alias("mass"), F.round("mz_theory", 8).alias("mz"))


@query("precursor_mass", f"WITH {sql.PSM_X} SELECT id, round(precursor_mz * charge - charge * 1.007276, 6) AS mass, round((precursor_mz - 1.007276) * charge, 6) AS mass_batched FROM px")
def precursor_mass(spark, sf_dir):
    mz, z = F.col("precursor_mz"), F.col("charge")
    return derive.psm_x(spark, sf_dir).select("id", F.round(masses.precursor_mass(mz, z), 6).alias("mass"), F.round(masses.precursor_mass_batched(mz, z), 6).alias("mass_batched"))


@query("ppm_error", f"WITH {sql.PSM_X} SELECT id, round((mz_theory - precursor_mz) / precursor_mz * 1e6, 3) AS ppm_0, round((mz_theory - (precursor_mz - 1.00335 / charge)) / precursor_mz * 1e6, 3) AS ppm_1 FROM px")
def ppm_error(spark, sf_dir):
    a = (F.col("mz_theory"), F.col("precursor_mz"), F.col("charge"))
    return derive.psm_x(spark, sf_dir).select("id", F.round(masses.ppm_error(*a, 0), 3).alias("ppm_0"), F.round(masses.ppm_error(*a, 1), 3).alias("ppm_1"))


@query("delta_mass_ppm", f"WITH {sql.PSM_X} SELECT id, round(least(abs((mz_theory - precursor_mz) / precursor_mz * 1e6), abs((mz_theory - (precursor_mz - 1.00335 / charge)) / precursor_mz * 1e6)), 3) AS delta FROM px")
def delta_mass_ppm(spark, sf_dir):
    return derive.psm_x(spark, sf_dir).select("id", F.round(masses.delta_mass_ppm(F.col("mz_theory"), F.col("precursor_mz"), F.col("charge")), 3).alias("delta"))


@query("scaled_mass", f"WITH {sql.PSM} SELECT DISTINCT nm[k] AS residue, CAST(round_even(ms[k] * 10000, 0) AS BIGINT) AS scaled FROM (SELECT nm, ms, unnest(ti) AS k FROM psm)")
def scaled_mass(spark, sf_dir):
    pairs = derive.psm(spark, sf_dir).select(F.explode(F.arrays_zip(F.col("targets").alias("t"), masses.masses(F.col("targets")).alias("m"))).alias("x"))
    return pairs.select(F.col("x.t").alias("residue"), masses.scaled(F.col("x.m")).alias("scaled")).distinct()


@query("meets_precursor_mass", f"WITH {sql.PSM_X}, r3 AS (SELECT id, (precursor_mz - 1.007276) * charge AS pm, (precursor_mz - 1.007276) * charge - (mz_theory - 1.007276) * charge AS rem FROM px) SELECT id, abs(rem) < 4.95e-5 * pm OR abs(rem - 1.00335) < 4.95e-5 * pm AS meets FROM r3")
def meets_precursor_mass(spark, sf_dir):
    z = F.col("charge")
    pm = masses.precursor_mass_batched(F.col("precursor_mz"), z)
    return derive.psm_x(spark, sf_dir).select("id", masses.meets_precursor_mass(pm - masses.precursor_mass_batched(F.col("mz_theory"), z), pm, 4.95e-5).alias("meets"))


@query("cumulative_mass", f"WITH {sql.PSM}, u AS (SELECT id, i, ms[ti[i]] AS m FROM (SELECT *, unnest(range(1, len(ti) + 1)) AS i FROM psm)) SELECT id, CAST(i AS INTEGER) AS pos, round(sum(m) OVER (PARTITION BY id ORDER BY i), 6) AS cum FROM u")
def cumulative_mass(spark, sf_dir):
    rows = derive.psm(spark, sf_dir).select("id", F.posexplode(masses.running(masses.masses(F.col("targets")))).alias("p", "m"))
    return rows.select("id", (F.col("p") + 1).alias("pos"), F.round("m", 6).alias("cum"))


_KEPT = """kp AS (SELECT pk.*, sp.precursor_mz FROM pk JOIN sp USING (id) WHERE mz BETWEEN 50 AND 2500 AND abs(mz - precursor_mz) > 2.0 AND intensity >= 0.1)"""
_TOP = """rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS rn, count(*) OVER (PARTITION BY id) AS n FROM kp),
    tp AS (SELECT * FROM rk WHERE rn <= 4),
    nr AS (SELECT id, mz, sqrt(intensity) / sqrt(sum(intensity) OVER (PARTITION BY id)) AS v FROM tp)"""


@query("spectrum_preprocess", f"""WITH {sql.SPECTRA}, {_KEPT}, {_TOP}
    SELECT id, round(mz, 6) AS mz, round(v, 9) AS intensity FROM nr UNION ALL SELECT id, 0.0, 1.0 FROM sp WHERE id NOT IN (SELECT id FROM kp)""")
def spectrum_preprocess(spark, sf_dir):
    done = peaks.processed(F.col("mz_array"), F.col("intensity_array"), F.col("precursor_mz"), 50.0, 2500.0, 2.0, 0.1, 4)
    return derive.spectra(spark, sf_dir).select("id", F.inline(done)).select("id", F.round("mz", 6).alias("mz"), F.round("intensity", 9).alias("intensity"))


@query("peaks_filtered", f"WITH {sql.SPECTRA}, {_KEPT} SELECT id, round(mz, 6) AS mz, round(intensity, 6) AS intensity FROM kp")
def peaks_filtered(spark, sf_dir):
    p = peaks.above(peaks.without_precursor(peaks.in_window(peaks.zipped(F.col("mz_array"), F.col("intensity_array")), 50, 2500), F.col("precursor_mz"), 2.0), 0.1)
    return derive.spectra(spark, sf_dir).select("id", F.inline(p)).select("id", F.round("mz", 6).alias("mz"), F.round("intensity", 6).alias("intensity"))


@query("topk_peaks", f"WITH {sql.SPECTRA}, t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY intensity DESC, mz) AS rn FROM pk) SELECT id, round(mz, 6) AS mz, round(intensity, 6) AS intensity FROM t WHERE rn <= 3")
def topk_peaks(spark, sf_dir):
    top = peaks.strongest(peaks.zipped(F.col("mz_array"), F.col("intensity_array")), 3)
    return derive.spectra(spark, sf_dir).select("id", F.inline(top)).select("id", F.round("mz", 6).alias("mz"), F.round("intensity", 6).alias("intensity"))


@query("unit_norm", f"WITH {sql.SPECTRA}, n AS (SELECT id, mz, sqrt(intensity) / sqrt(sum(intensity) OVER (PARTITION BY id)) AS v FROM pk) SELECT id, round(mz, 6) AS mz, round(v, 9) AS intensity FROM n")
def unit_norm(spark, sf_dir):
    p = peaks.unit_norm(peaks.zipped(F.col("mz_array"), F.col("intensity_array")))
    return derive.spectra(spark, sf_dir).select("id", F.inline(p)).select("id", F.round("mz", 6).alias("mz"), F.round("intensity", 9).alias("intensity"))


@query("dummy_spectra", f"WITH {sql.SPECTRA}, {_KEPT} SELECT count(*) AS n_dummy FROM sp WHERE id NOT IN (SELECT id FROM kp)")
def dummy_spectra(spark, sf_dir):
    done = peaks.processed(F.col("mz_array"), F.col("intensity_array"), F.col("precursor_mz"), 50.0, 2500.0, 2.0, 0.1, 4)
    return derive.spectra(spark, sf_dir).select(done.alias("p")).agg(F.count_if(F.get("p", 0)["mz"] == 0).alias("n_dummy"))


@query("cosine_schedule", """WITH k AS (SELECT event_id, event_id % 20 AS t FROM events), a AS (SELECT event_id, t, pow(cos((t / 20 + 0.008) / 1.008 * pi() / 2), 2) AS x, pow(cos(((t + 1) / 20 + 0.008) / 1.008 * pi() / 2), 2) AS y FROM k)
    SELECT event_id, CAST(t AS INTEGER) AS step, round(least(1 - y / x, 0.999), 9) AS beta FROM a""")
def cosine_schedule(spark, sf_dir):
    """The noise of each event's step of the schedule."""
    step, betas = (F.col("event_id") % 20).cast("int"), F.array(*[F.lit(b) for b in numeric.cosine_betas(20)])
    return table(spark, sf_dir, "events").select("event_id", step.alias("step"), F.round(F.get(betas, step), 9).alias("beta"))


_DIST = """d AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS a, list_transform(list_reverse(embedding), lambda v: CAST(v AS DOUBLE)) AS b FROM embeddings),
    q AS (SELECT vec_id, list_transform(a, lambda v: v - ln(list_sum(list_transform(a, lambda w: exp(w))))) AS p, list_transform(b, lambda v: v - ln(list_sum(list_transform(b, lambda w: exp(w))))) AS q FROM d)"""


def _distributions(spark, sf_dir):
    soft = lambda c: F.transform(c, lambda v: v - F.col("z"))
    df = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    df = df.withColumn("z", F.log(F.aggregate(F.transform("a", F.exp), F.lit(0.0), lambda s, v: s + v)))
    return df.select("vec_id", soft(F.col("a")).alias("p"), F.reverse(soft(F.col("a"))).alias("q"))


@query("kl_divergence", f"WITH {_DIST} SELECT vec_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: exp(p[i]) * (p[i] - q[i]))), 6) AS kl FROM q")
def kl_divergence(spark, sf_dir):
    return _distributions(spark, sf_dir).select("vec_id", F.round(numeric.kl_divergence(F.col("p"), F.col("q")), 6).alias("kl"))


@query("log_mixture", f"WITH {_DIST} SELECT vec_id, {text_sql('list_transform(p, lambda v: ln(0.9 * exp(v) + 0.1 / 64))', 5)} AS mixed FROM q")
def log_mixture(spark, sf_dir):
    import math

    return _distributions(spark, sf_dir).select("vec_id", as_text(numeric.mixture(F.col("p"), math.log(0.9), math.log(0.1), 64), 5).alias("mixed"))


@query("encoder_pool", """WITH e AS (SELECT vec_id // 4 AS spectrum, vec_id, embedding FROM embeddings), u AS (SELECT spectrum, vec_id, unnest(range(1, 65)) AS dim, embedding FROM e),
    v AS (SELECT spectrum, dim, CAST(embedding[dim] AS DOUBLE) AS x FROM u WHERE vec_id % 4 <> 3)
    SELECT spectrum, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean, round(max(x) FILTER (x <> 0), 6) AS max FROM v GROUP BY spectrum, dim""")
def encoder_pool(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 4).alias("spectrum"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    lists = e.groupBy("spectrum").agg(F.array_sort(F.collect_list(F.struct("vec_id", "v"))).alias("x"))
    vectors, mask = F.transform("x", lambda r: r["v"]), F.transform("x", lambda r: r["vec_id"] % 4 == 3)
    both = lists.select("spectrum", numeric.pooled(vectors, mask, "mean").alias("mean"), numeric.pooled(vectors, mask, "max").alias("max"))
    rows = both.select("spectrum", F.posexplode(F.arrays_zip("mean", "max")).alias("pos", "r"))
    return rows.select("spectrum", (F.col("pos") + 1).alias("dim"), F.round("r.mean", 6).alias("mean"), F.round("r.max", 6).alias("max"))


@query("encoder_wide", "SELECT vec_id AS spectrum_id, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS spectrum_encoding_{i}" for i in range(64)) + " FROM embeddings")
def encoder_wide(spark, sf_dir):
    from peakloom.sources.sinks import widened

    wide = widened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return wide.select(F.col("vec_id").alias("spectrum_id"), *[F.round(F.col(f"spectrum_encoding_{i}").cast("double"), 6).alias(f"spectrum_encoding_{i}") for i in range(64)])


@query("embedding_spectra", """WITH e AS (SELECT vec_id, unnest(range(1, 65)) AS i, embedding FROM embeddings), p AS (SELECT vec_id, 50 + 30 * i AS mz, abs(CAST(embedding[i] AS DOUBLE)) AS x FROM e),
    k AS (SELECT vec_id, mz, x FROM p WHERE x >= 0.05 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, mz) <= 10)
    SELECT vec_id, CAST(mz AS DOUBLE) AS mz, round(sqrt(x) / sqrt(sum(x) OVER (PARTITION BY vec_id)), 6) AS intensity FROM k""")
def embedding_spectra(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    mz = F.transform("embedding", lambda v, i: (50 + 30 * (i + 1)).cast("double"))
    x = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    done = peaks.unit_norm(peaks.strongest(peaks.above(peaks.zipped(mz, x), 0.05), 10))
    return e.select("vec_id", F.inline(done)).select("vec_id", "mz", F.round("intensity", 6).alias("intensity"))


@query("text_tokens", rf"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{TOKEN_PATTERN}')), 0)::INTEGER AS n FROM documents")
def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tokens.tokenize(F.col("text"))).alias("n"))
