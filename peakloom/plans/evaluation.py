"""Queries on identifications: matches, precision and recall, curves, thresholds, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakloom.functions.masses import delta_mass_ppm, matches_precursor
from peakloom.operators import metrics
from peakloom.operators.joins import keep_unrefined, with_group
from peakloom.plans import derive, sql
from peakloom.sources.loader import read_predictions
from peakloom.sources.sinks import write_csv
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


def _rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


RATIOS = ("aa_prec", "aa_recall", "pep_recall", "pep_prec")


@query("eval_precision_recall", f"WITH {sql.PSM}{sql.matched('psm', 'pi_full')} SELECT {sql.ratios()} FROM (SELECT *, n_pred > 0 AS c FROM mt)")
def eval_precision_recall(spark, sf_dir):
    return _rounded(metrics.precision_recall(metrics.matches(derive.psm(spark, sf_dir))), *RATIOS)


@query("eval_at_threshold", f"WITH {sql.PSM_X}{sql.matched('px', 'pi')} SELECT {sql.ratios()} FROM (SELECT *, n_pred > 0 AND confidence >= 0.5 AS c FROM mt)")
def eval_at_threshold(spark, sf_dir):
    return _rounded(metrics.precision_recall(metrics.matches(derive.psm_x(spark, sf_dir)), confidence="confidence", threshold=0.5), *RATIOS)


@query("eval_by_group", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')}{sql.GROUPS}
    SELECT coalesce(grp, 'no_group') AS "group", {sql.ratios()} FROM (SELECT *, n_pred > 0 AS c FROM mt) LEFT JOIN gm USING (id) GROUP BY ALL""")
def eval_by_group(spark, sf_dir):
    return _rounded(metrics.precision_recall(metrics.matches(derive.psm_grouped(spark, sf_dir)), ("group",)), *RATIOS)


@query("eval_rollup", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')}{sql.GROUPS}, j AS (SELECT *, n_pred > 0 AS c, coalesce(grp, 'no_group') AS g FROM mt LEFT JOIN gm USING (id))
    SELECT g AS "group", {sql.ratios()} FROM j GROUP BY g UNION ALL SELECT 'all', {sql.ratios()} FROM j""")
def eval_rollup(spark, sf_dir):
    return _rounded(metrics.precision_recall_rollup(metrics.matches(derive.psm_grouped(spark, sf_dir)), "group"), *RATIOS)


_AS_TEXT = "array_to_string(list_transform({x}, lambda k: chr(64 + CAST(CASE WHEN k = 9 THEN 8 ELSE k END AS INTEGER))), '')"


@query("aa_error_rate", f"""WITH {sql.PSM_X}, e AS (SELECT levenshtein({_AS_TEXT.format(x='ti')}, {_AS_TEXT.format(x='pi')}) AS d, len(ti) AS n FROM px)
    SELECT CAST(sum(d) AS BIGINT) AS n_edits, CAST(sum(n) AS BIGINT) AS n_ref, round(sum(d)::DOUBLE / sum(n), 9) AS aa_er FROM e""")
def aa_error_rate(spark, sf_dir):
    return _rounded(metrics.aa_error_rate(derive.psm_x(spark, sf_dir), "targets", "predictions"), "aa_er")


_CURVE = f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')},
    o AS (SELECT confidence AS c, row_number() OVER (ORDER BY confidence, id) AS rn, count(*) OVER () AS n FROM mt),
    k AS (SELECT unnest(range(0, 21)) AS k),
    th AS (SELECT k, c AS threshold FROM k JOIN o ON rn = CASE WHEN k = 20 THEN n ELSE 1 + n * k // 20 END),
    cu AS (SELECT CAST(k AS INTEGER) AS k, threshold, sum(CASE WHEN confidence >= threshold AND n_pred > 0 THEN pep_match ELSE 0 END)::DOUBLE / count(*) AS pep_recall,
              CASE WHEN count(*) FILTER (confidence >= threshold AND n_pred > 0) = 0 THEN 1.0 ELSE
              sum(CASE WHEN confidence >= threshold AND n_pred > 0 THEN pep_match ELSE 0 END)::DOUBLE / count(*) FILTER (confidence >= threshold AND n_pred > 0) END AS pep_prec
           FROM th, mt GROUP BY k, threshold)"""


@query("pr_curve", _CURVE + " SELECT k, threshold, round(pep_recall, 9) AS pep_recall, round(pep_prec, 9) AS pep_prec FROM cu")
def pr_curve(spark, sf_dir):
    return _rounded(metrics.pr_curve(metrics.matches(derive.psm_x(spark, sf_dir))), "pep_recall", "pep_prec")


@query("pr_auc", _CURVE + """, s AS (SELECT pep_recall - lag(pep_recall) OVER (ORDER BY k DESC) AS w, pep_prec AS p, lag(pep_prec) OVER (ORDER BY k DESC) AS q FROM cu)
    SELECT round(sum(w * (p + q) / 2), 9) AS auc FROM s""")
def pr_auc(spark, sf_dir):
    return _rounded(metrics.pr_auc(metrics.pr_curve(metrics.matches(derive.psm_x(spark, sf_dir)))), "auc")


@query("fdr_threshold", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')},
    o AS (SELECT confidence, row_number() OVER w AS rn, sum(pep_match) OVER w AS f, count(*) OVER () AS n FROM mt WINDOW w AS (ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING))
    SELECT rn AS rank, round(f::DOUBLE / n, 9) AS recall, confidence AS threshold FROM o WHERE f::DOUBLE / rn > 1 - 0.1 ORDER BY rn DESC LIMIT 1""")
def fdr_threshold(spark, sf_dir):
    return _rounded(metrics.recall_at_fdr(metrics.matches(derive.psm_x(spark, sf_dir)), 0.1), "recall")


@query("recall_at_fdr_by_group", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')}{sql.GROUPS},
    o AS (SELECT coalesce(grp, 'no_group') AS g, confidence, row_number() OVER w AS rn, sum(pep_match) OVER w AS f, count(*) OVER (PARTITION BY coalesce(grp, 'no_group')) AS n
          FROM mt LEFT JOIN gm USING (id) WINDOW w AS (PARTITION BY coalesce(grp, 'no_group') ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING))
    SELECT g AS "group", round(f::DOUBLE / n, 9) AS recall, confidence AS threshold FROM o WHERE f::DOUBLE / rn > 1 - 0.1 QUALIFY row_number() OVER (PARTITION BY g ORDER BY rn DESC) = 1""")
def recall_at_fdr_by_group(spark, sf_dir):
    return _rounded(metrics.recall_at_fdr_by(metrics.matches(derive.psm_grouped(spark, sf_dir)), "group", 0.1), "recall")


@query("peptide_matches", f"WITH {sql.PSM_X}{sql.matched('px', 'pi')} SELECT id, CAST(n_targ AS INTEGER) AS n_targ, CAST(n_pred AS INTEGER) AS n_pred, CAST(n_match AS INTEGER) AS n_match, pep_match FROM mt")
def peptide_matches(spark, sf_dir):
    return metrics.matches(derive.psm_x(spark, sf_dir)).select("id", "n_targ", "n_pred", "n_match", "pep_match")


QUERIES["novor_fold"] = lambda spark, sf_dir: metrics.matches(derive.psm(spark, sf_dir)).select("id", F.col("n_match").cast("bigint").alias("n_match"))
QUERIES["novor_band_join"] = lambda spark, sf_dir: metrics.matches_by_band(derive.psm(spark, sf_dir), "id", "targets", "predictions")
SQL["novor_fold"] = SQL["novor_band_join"] = f"WITH {sql.PSM}{sql.matched('psm', 'pi_full')} SELECT id, n_match FROM mt"


@query("running_precision", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')} SELECT id, row_number() OVER w AS rank, CAST(sum(pep_match) OVER w AS BIGINT) AS found,
    round(sum(pep_match) OVER w / row_number() OVER w, 9) AS precision FROM mt WINDOW w AS (ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING)""")
def running_precision(spark, sf_dir):
    ranked = metrics.running_precision(metrics.matches(derive.psm_x(spark, sf_dir)))
    return _rounded(ranked.select("id", F.col("rank").cast("bigint").alias("rank"), "found", "precision"), "precision")


_PPM = """least(abs((mz_pred - precursor_mz) / precursor_mz * 1e6), abs((mz_pred - (precursor_mz - 1.00335 / charge)) / precursor_mz * 1e6))"""
_MZ_PRED = "(coalesce(list_sum(list_transform(pi, lambda k: ms[k])), 0) + 18.0106) / charge + 1.007276"


def _with_errors(spark, sf_dir):
    from peakloom.functions.masses import sequence_mass

    df = metrics.matches(derive.psm_x(spark, sf_dir)).withColumn("mz_pred", sequence_mass(F.col("predictions"), F.col("charge")))
    return df.withColumn("delta_mass_ppm", delta_mass_ppm(F.col("mz_pred"), F.col("precursor_mz"), F.col("charge")))


_REPORT = f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')}, d0 AS (SELECT *, {_MZ_PRED} AS mz_pred FROM mt), d AS (SELECT *, {_PPM} AS ppm FROM d0),
    o AS (SELECT confidence, row_number() OVER w AS rn, sum(pep_match) OVER w AS f FROM mt WINDOW w AS (ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING)),
    lim AS (SELECT confidence AS t FROM o WHERE f::DOUBLE / rn > 1 - 0.1 ORDER BY rn DESC LIMIT 1)"""


@query("eval_report", f"""{_REPORT}
    SELECT 'all' AS section, {sql.ratios()} FROM (SELECT *, n_pred > 0 AS c FROM d)
    UNION ALL SELECT 'fdr', {sql.ratios()} FROM (SELECT *, n_pred > 0 AND confidence >= t AS c FROM d, lim)
    UNION ALL SELECT 'ppm', {sql.ratios()} FROM (SELECT *, n_pred > 0 AND ppm < 20.5 AS c FROM d)
    UNION ALL SELECT 'confidence', {sql.ratios()} FROM (SELECT *, n_pred > 0 AND confidence > 0.4 AS c FROM d)""")
def eval_report(spark, sf_dir):
    return _rounded(metrics.report(_with_errors(spark, sf_dir), 0.1, 20.5, 0.4), *RATIOS)


@query("eval_report_by_group", f"""{_REPORT}{sql.GROUPS}, g AS (SELECT d.*, coalesce(grp, 'no_group') AS grp2 FROM d LEFT JOIN gm USING (id)),
    go AS (SELECT grp2, confidence, row_number() OVER w AS rn, sum(pep_match) OVER w AS f FROM g WINDOW w AS (PARTITION BY grp2 ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING)),
    gl AS (SELECT grp2, confidence AS t FROM go WHERE f::DOUBLE / rn > 1 - 0.1 QUALIFY row_number() OVER (PARTITION BY grp2 ORDER BY rn DESC) = 1)
    SELECT grp2 AS "group", 'all' AS section, {sql.ratios()} FROM (SELECT *, n_pred > 0 AS c FROM g) GROUP BY grp2
    UNION ALL SELECT grp2, 'fdr', {sql.ratios()} FROM (SELECT g.*, n_pred > 0 AND confidence >= coalesce(t, 1.0) AS c FROM g LEFT JOIN gl USING (grp2)) GROUP BY grp2
    UNION ALL SELECT grp2, 'ppm', {sql.ratios()} FROM (SELECT *, n_pred > 0 AND ppm < 20.5 AS c FROM g) GROUP BY grp2
    UNION ALL SELECT grp2, 'confidence', {sql.ratios()} FROM (SELECT *, n_pred > 0 AND confidence > 0.4 AS c FROM g) GROUP BY grp2""")
def eval_report_by_group(spark, sf_dir):
    grouped = with_group(_with_errors(spark, sf_dir), derive.group_map(spark, sf_dir), "id")
    return _rounded(metrics.report(grouped, 0.1, 20.5, 0.4, by="group"), *RATIOS)


@query("aa_error_rate_by_group", f"""WITH {sql.PSM_X}{sql.GROUPS}, e AS (SELECT coalesce(grp, 'no_group') AS g, levenshtein({_AS_TEXT.format(x='ti')}, {_AS_TEXT.format(x='pi')}) AS d, len(ti) AS n FROM px LEFT JOIN gm USING (id))
    SELECT g AS "group", CAST(sum(d) AS BIGINT) AS n_edits, CAST(sum(n) AS BIGINT) AS n_ref, round(sum(d)::DOUBLE / sum(n), 9) AS aa_er FROM e GROUP BY g""")
def aa_error_rate_by_group(spark, sf_dir):
    return _rounded(metrics.aa_error_rate(derive.psm_grouped(spark, sf_dir), "targets", "predictions", ("group",)), "aa_er")


@query("strict_curve", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')}, k AS (SELECT unnest(range(0, 100)) / 99 AS threshold),
    c AS (SELECT threshold, count(*) FILTER (pep_match = 1 AND confidence > threshold) AS tp, count(*) FILTER (pep_match = 0 AND confidence > threshold) AS fp,
          count(*) FILTER (pep_match = 1 AND confidence <= threshold) AS fn FROM k, mt GROUP BY threshold)
    SELECT round(threshold, 9) AS threshold, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 9) END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 9) END AS recall FROM c""")
def strict_curve(spark, sf_dir):
    return _rounded(metrics.strict_curve(metrics.matches(derive.psm_x(spark, sf_dir))), "threshold", "precision", "recall")


@query("ppm_filtered_eval", f"{_REPORT} SELECT {sql.ratios()} FROM (SELECT *, n_pred > 0 AND ppm < 20.5 AS c FROM d)")
def ppm_filtered_eval(spark, sf_dir):
    df = _with_errors(spark, sf_dir)
    ok = F.col("delta_mass_ppm") < 20.5
    return _rounded(metrics.precision_recall(df.withColumns({c: F.when(ok, F.col(c)).otherwise(0) for c in ("n_pred", "n_match", "pep_match")})), *RATIOS)


@query("confidence_filtered_eval", f"{_REPORT} SELECT {sql.ratios()} FROM (SELECT *, n_pred > 0 AND confidence > 0.4 AS c FROM d)")
def confidence_filtered_eval(spark, sf_dir):
    df = metrics.matches(derive.psm_x(spark, sf_dir))
    ok = F.exp(F.log("confidence")) > 0.4
    return _rounded(metrics.precision_recall(df.withColumns({c: F.when(ok, F.col(c)).otherwise(0) for c in ("n_pred", "n_match", "pep_match")})), *RATIOS)


@query("validate_precursor", f"""WITH {sql.PSM_X}, m AS (SELECT least(abs((mz_theory - precursor_mz) / precursor_mz * 1e6), abs((mz_theory - (precursor_mz - 1.00335 / charge)) / precursor_mz * 1e6)) AS d FROM px)
    SELECT count(*) AS n_rows, count(*) FILTER (d < 50.5) AS n_50, count(*) FILTER (d < 20.5) AS n_20 FROM m""")
def validate_precursor(spark, sf_dir):
    hit = lambda tol: F.count_if(matches_precursor(F.col("mz_theory"), F.col("precursor_mz"), F.col("charge"), tol))
    return derive.psm_x(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows"), hit(50.5).alias("n_50"), hit(20.5).alias("n_20"))


_STRIP = "replace(array_to_string(list_transform({x}, lambda k: nm[k]), ''), 'I', 'L')"


@query("stripped_recall", f"WITH {sql.PSM_X} SELECT round(avg(CASE WHEN {_STRIP.format(x='ti')} = {_STRIP.format(x='pi')} THEN 1.0 ELSE 0.0 END), 9) AS recall FROM px")
def stripped_recall(spark, sf_dir):
    from peakloom.functions.tokens import remove_modifications

    bare = lambda c: remove_modifications(F.array_join(c, ""))
    return derive.psm_x(spark, sf_dir).agg(F.round(F.avg((bare("targets") == bare("predictions")).cast("double")), 9).alias("recall"))


_GRID = """k AS (SELECT CAST(unnest(range(0, 50)) AS INTEGER) AS k)"""


@query("tp_fp_curve", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')}, {_GRID}, b AS (SELECT pep_match, confidence AS cell FROM mt)
    SELECT round(k / 49, 9) AS threshold, count(*) FILTER (pep_match = 1) AS tp, count(*) FILTER (pep_match = 0) AS fp,
           round(count(*) FILTER (pep_match = 1) / count(*), 9) AS precision FROM k LEFT JOIN b ON cell >= k / 49 GROUP BY k HAVING count(pep_match) > 0""")
def tp_fp_curve(spark, sf_dir):
    rows = metrics.threshold_counts(
        metrics.matches(derive.psm_x(spark, sf_dir)), "confidence", {"tp": F.col("pep_match") == 1, "fp": F.col("pep_match") == 0}
    ).where("tp + fp > 0")
    return rows.select(F.round("threshold", 9).alias("threshold"), "tp", "fp", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 9).alias("precision"))


@query("mapped_by_threshold", f"""WITH {sql.PSM_X}, {_GRID}, b AS (SELECT id % 4 <> 0 AS mapped, confidence AS cell FROM px)
    SELECT round(k / 49, 9) AS threshold, count(*) FILTER (mapped) AS mapped, count(*) FILTER (NOT mapped) AS unmapped FROM k LEFT JOIN b ON cell >= k / 49 GROUP BY k""")
def mapped_by_threshold(spark, sf_dir):
    flags = {"mapped": F.col("id") % 4 != 0, "unmapped": F.col("id") % 4 == 0}
    return metrics.threshold_counts(derive.psm_x(spark, sf_dir), "confidence", flags).withColumn("threshold", F.round("threshold", 9))


@query("mapped_by_protein", f"""WITH {sql.PSM_X}, {_GRID}, b AS (SELECT CASE WHEN id % 4 <> 0 THEN 'P' || CAST(id % 97 AS VARCHAR) END AS protein_id, confidence AS cell FROM px)
    SELECT round(k / 49, 9) AS threshold, count(protein_id) AS mapped, count(cell) - count(protein_id) AS unmapped FROM k LEFT JOIN b ON cell >= k / 49 GROUP BY k""")
def mapped_by_protein(spark, sf_dir):
    """Mapped predictions are those with a protein in a table of predictions as CSV files hold it."""
    path = f"{shared_dir(spark)}/mapped-{uuid.uuid4().hex}"
    protein = F.when(F.col("id") % 4 != 0, F.concat(F.lit("P"), (F.col("id") % 97).cast("string")))
    write_csv(derive.psm_x(spark, sf_dir).select("id", "confidence", protein.alias("protein_id")), path)
    rows = read_predictions(spark, path, "id", "protein_id", "confidence")
    flags = {"mapped": F.col("protein_id").isNotNull(), "unmapped": F.col("protein_id").isNull()}
    return metrics.threshold_counts(rows, "confidence", flags).withColumn("threshold", F.round("threshold", 9))


@query("normalised_recall", f"""WITH {sql.PSM_X} SELECT round(avg(CASE WHEN {_STRIP.format(x='ti')} = {_STRIP.format(x='pi')} THEN 1.0 ELSE 0.0 END), 9) AS recall FROM px""")
def normalised_recall(spark, sf_dir):
    from peakloom.functions.tokens import normalised

    bare = lambda c: normalised(F.array_join(c, ""))
    return derive.psm_x(spark, sf_dir).agg(F.round(F.avg((bare("targets") == bare("predictions")).cast("double")), 9).alias("recall"))


@query("first_threshold_at_precision", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')}, {_GRID}, b AS (SELECT pep_match, confidence AS cell FROM mt),
    c AS (SELECT k, count(*) FILTER (pep_match = 1) / count(*) AS p FROM k JOIN b ON cell >= k / 49 GROUP BY k) SELECT round(min(k / 49) FILTER (p >= 0.9), 9) AS threshold FROM c""")
def first_threshold_at_precision(spark, sf_dir):
    rows = metrics.threshold_counts(
        metrics.matches(derive.psm_x(spark, sf_dir)), "confidence", {"tp": F.col("pep_match") == 1, "fp": F.col("pep_match") == 0}
    )
    good = F.try_divide("tp", F.col("tp") + F.col("fp")) >= 0.9
    return rows.agg(F.round(F.min(F.when(good, F.col("threshold"))), 9).alias("threshold"))


@query("residue_recall", f"""WITH {sql.PSM_X}, u AS (SELECT nm[ti[i]] AS residue, CASE WHEN nm[ti[i]] = nm[pi[i]] THEN 1 ELSE 0 END AS hit FROM (SELECT *, unnest(range(1, len(ti) + 1)) AS i FROM px))
    SELECT residue, count(*) AS n, round(avg(hit), 9) AS recall FROM u WHERE residue IN ('I', 'L') GROUP BY residue""")
def residue_recall(spark, sf_dir):
    pairs = derive.psm_x(spark, sf_dir).select(F.posexplode("targets").alias("i", "residue"), "predictions").where(F.col("residue").isin("I", "L"))
    hit = F.coalesce(F.col("residue") == F.get("predictions", F.col("i")), F.lit(False))
    return pairs.groupBy("residue").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit.cast("double")), 9).alias("recall"))


@query("confidence_hist", f"WITH {sql.PSM_X} SELECT CAST(least(20, 1 + floor(confidence * 20)) AS BIGINT) AS bin, count(*) AS n FROM px GROUP BY bin")
def confidence_hist(spark, sf_dir):
    bin_ = F.least(F.lit(20), 1 + F.floor(F.col("confidence") * 20)).cast("bigint")
    return derive.psm_x(spark, sf_dir).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("refinement_arbitrate", f"""WITH {sql.PSM_X}, s AS (SELECT id, ln(confidence + 0.001) AS refined, ln((id * 31 % 997 + 1) / 998.0) AS earlier, id % 3 = 0 AS earlier_match, id % 2 = 0 AS refined_match FROM px)
    SELECT id, earlier < ln(0.9) AND earlier_match AND NOT refined_match AND earlier > refined AS keep_earlier FROM s""")
def refinement_arbitrate(spark, sf_dir):
    key = F.col("id")
    df = derive.psm_x(spark, sf_dir).select(
        "id", F.log(F.col("confidence") + 0.001).alias("refined"), F.log((key * 31 % 997 + 1) / 998.0).alias("earlier"),
        (key % 3 == 0).alias("earlier_match"), (key % 2 == 0).alias("refined_match"),
    )
    return df.select("id", keep_unrefined(F.col("refined_match"), F.col("refined"), F.col("earlier_match"), F.col("earlier")).alias("keep_earlier"))


@query("eval_batch_mean", f"""WITH {sql.PSM_X}{sql.matched('px', 'pi')}, b AS (SELECT id // 128 AS batch, sum(n_match)::DOUBLE / sum(n_targ) AS aa_recall, avg(pep_match) AS pep_recall FROM mt GROUP BY batch)
    SELECT round(avg(aa_recall), 9) AS aa_recall, round(avg(pep_recall), 9) AS pep_recall, count(*) AS n_batches FROM b""")
def eval_batch_mean(spark, sf_dir):
    rows = metrics.matches(derive.psm_x(spark, sf_dir)).withColumn("batch", F.floor(F.col("id") / 128))
    parts = metrics.precision_recall(rows, ("batch",))
    return parts.agg(F.round(F.avg("aa_recall"), 9).alias("aa_recall"), F.round(F.avg("pep_recall"), 9).alias("pep_recall"), F.count(F.lit(1)).alias("n_batches"))
