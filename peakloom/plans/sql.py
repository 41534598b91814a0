"""SQL fragments (DuckDB) of the derived tables."""

from __future__ import annotations

from peakloom.constants import AMINO_ACIDS, CARBON_MASS_DELTA, H2O_MASS, PROTON_MASS, RESIDUE_REMAPPING, TOKEN_PATTERN

NAMES = "[" + ", ".join(f"'{r}'" for r in AMINO_ACIDS) + "]"
MASSES = "CAST([" + ", ".join(str(m) for m in AMINO_ACIDS.values()) + "] AS DOUBLE[])"
TOKENS = f"regexp_extract_all(%s, '{TOKEN_PATTERN}')"
REMAP = "CASE t " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RESIDUE_REMAPPING.items()) + " ELSE t END"

PSM = f"""
r AS (SELECT {NAMES} AS nm, {MASSES} AS ms),
psm AS (SELECT o_orderkey AS id, o_custkey AS cust, 6 + o_orderkey % 8 AS len,
        list_transform(range(1, 7 + o_orderkey % 8), lambda i: 1 + (o_orderkey * 7 + i * i * 3 + o_custkey) % 20) AS ti,
        list_transform(range(1, 7 + o_orderkey % 8), lambda i: 1 + ((o_orderkey * 7 + i * i * 3 + o_custkey) % 20
            + CASE WHEN o_orderkey % 5 = 0 AND i = 3 THEN 1 ELSE 0 END) % 20) AS pi_full,
        nm, ms FROM orders, r)"""

PSM_X = PSM + f""",
px0 AS (SELECT id, cust, ti, CASE WHEN id % 11 = 0 THEN [] ELSE pi_full END AS pi, nm, ms,
        round(0.7 * ((id * 7919) % 1000) / 1000 + CASE WHEN id % 5 = 0 THEN 0 ELSE 0.3 END, 6) AS confidence, 1 + id % 4 AS charge,
        (list_sum(list_transform(ti, lambda k: ms[k])) + {H2O_MASS}) / (1 + id % 4) + {PROTON_MASS} AS mz_theory FROM psm),
px AS (SELECT *, mz_theory * (1 + ((id % 121) - 60) * 1e-6) + CASE WHEN id % 9 = 0 THEN {CARBON_MASS_DELTA} / charge ELSE 0 END AS precursor_mz FROM px0)"""


def matched(source: str, pi: str) -> str:
    """CTEs that end in mt (id, n_targ, n_pred, n_match, pep_match): residues matched by prefix masses within an id."""
    return f""",
ta AS (SELECT id, p, ms[ti[p]] AS m FROM (SELECT id, ti, ms, unnest(range(1, len(ti) + 1)) AS p FROM {source})),
tb AS (SELECT id, p, ms[pi[p]] AS m FROM (SELECT id, {pi} AS pi, ms, unnest(range(1, len({pi}) + 1)) AS p FROM {source})),
ca AS (SELECT id, m, sum(m) OVER (PARTITION BY id ORDER BY p) AS c FROM ta),
cb AS (SELECT id, m, sum(m) OVER (PARTITION BY id ORDER BY p) AS c FROM tb),
hit AS (SELECT ca.id, count(*) AS n FROM ca JOIN cb ON ca.id = cb.id AND abs(ca.c - cb.c) < 0.5 AND abs(ca.m - cb.m) < 0.1 GROUP BY ca.id),
mt AS (SELECT s.*, len(ti) AS n_targ, len({pi}) AS n_pred, coalesce(hit.n, 0) AS n_match,
       CASE WHEN len(ti) = len({pi}) AND coalesce(hit.n, 0) = len(ti) THEN 1 ELSE 0 END AS pep_match
       FROM {source} s LEFT JOIN hit USING (id))"""


def ratios(digits: int = 9) -> str:
    """The select list of precision and recall over rows with n_targ, n_pred, n_match, pep_match and a flag c."""
    return f"""CAST(sum(n_targ) AS BIGINT) AS n_targ_aa, CAST(sum(CASE WHEN c THEN n_pred ELSE 0 END) AS BIGINT) AS n_pred_aa,
        CAST(sum(CASE WHEN c THEN n_match ELSE 0 END) AS BIGINT) AS n_match_aa, count(*) AS n_targ_pep,
        count(*) FILTER (c) AS n_pred_pep, CAST(sum(CASE WHEN c THEN pep_match ELSE 0 END) AS BIGINT) AS n_match_pep,
        round(CASE WHEN count(*) FILTER (c) = 0 THEN 1.0 ELSE sum(CASE WHEN c THEN n_match ELSE 0 END)::DOUBLE / sum(CASE WHEN c THEN n_pred ELSE 0 END) END, {digits}) AS aa_prec,
        round(sum(CASE WHEN c THEN n_match ELSE 0 END)::DOUBLE / sum(n_targ), {digits}) AS aa_recall,
        round(sum(CASE WHEN c THEN pep_match ELSE 0 END)::DOUBLE / count(*), {digits}) AS pep_recall,
        round(CASE WHEN count(*) FILTER (c) = 0 THEN 1.0 ELSE sum(CASE WHEN c THEN pep_match ELSE 0 END)::DOUBLE / count(*) FILTER (c) END, {digits}) AS pep_prec"""


GROUPS = """,
gm AS (SELECT o_orderkey AS id, r_name AS grp FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 13 <> 0)"""

SPECTRA = """
pk AS (SELECT l_orderkey AS id, l_extendedprice / 40 AS mz, l_quantity / 50 AS intensity, l_quantity AS q, l_partkey AS p, l_suppkey AS s, l_extendedprice AS x
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
sp AS (SELECT o_orderkey AS id, o_totalprice / 200 AS precursor_mz, 1 + o_orderkey % 4 AS precursor_charge FROM orders
       WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""

STRINGS = PSM + """,
st0 AS (SELECT id, list_transform(ti, lambda k: CASE WHEN nm[k] = 'M' AND id % 3 = 0 THEN 'M[UNIMOD:35]' WHEN nm[k] = 'C' AND id % 4 = 0 THEN 'C(+57.02)'
            WHEN nm[k] = 'N' AND id % 5 = 0 THEN 'N(+.98)' WHEN nm[k] = 'S' AND id % 7 = 0 THEN 'S(p)' ELSE nm[k] END) AS tk FROM psm),
st1 AS (SELECT id, CASE WHEN id % 6 = 0 THEN '[UNIMOD:1]-' WHEN id % 6 = 1 THEN '(+42.01)' ELSE '' END
            || CASE WHEN id % 17 = 0 THEN array_to_string(tk, ',') ELSE array_to_string(tk, '') END AS w FROM st0),
st AS (SELECT id, CASE WHEN id % 19 = 0 THEN NULL WHEN id % 10 = 0 THEN '_' || w || '_' WHEN id % 10 = 1 THEN '.' || w || '.' ELSE w END AS peptide FROM st1)"""


def share(key: str, seed: int = 0) -> str:
    return f"((((({key}) * 48271 + {seed}) % 2147483647) * 69621) % 2147483647) % 1000000"
