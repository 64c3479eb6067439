"""SQL texts of the derived views, for building check queries."""

from __future__ import annotations


def bucket10(h: str) -> str:
    c = [f"('0x' || substr({h}, {1 + 8 * i}, 8))::BIGINT" for i in range(8)]
    return f"(({c[7]} + 6 * ({' + '.join(c[:7])})) % 10)"


def split_of(h: str) -> str:
    b = bucket10(h)
    return f"(CASE {b} WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END)"


def wrap(x: str) -> str:
    """Angle in [-pi, pi) with the sign rule of a floored remainder."""
    t = "2*pi()"
    return f"(((({x}) + pi()) % ({t}) + ({t})) % ({t}) - pi())"


def floored_wrap(x: str) -> str:
    """Angle in [-pi, pi) by the floored remainder itself: 2 pi is added to negative remainders only.

    Adding it to all of them, as ``wrap`` does, costs the last bits of an angle.
    """
    t = "2*pi()"
    r = f"((({x}) + pi()) % ({t}))"
    return f"(CASE WHEN {r} < 0 THEN ({r} + {t}) % ({t}) ELSE {r} END - pi())"


ROLE = (
    "CASE {n} % 5 WHEN 0 THEN 'signal' WHEN 4 THEN 'qcd_candidate' ELSE 'qcd_active' END"
)
ROLES = f"""roles AS (
  SELECT (18000 + n_nationkey)::BIGINT AS record_id, {ROLE.format(n='n_nationkey')} AS role
  FROM nation)"""

PFN = "'root://synthetic.invalid//store/' || {r} || '/file-' || {f} || '.root'"

JETS = f"""raw_jets AS (
  SELECT o_orderkey, (18000 + c_nationkey)::BIGINT AS record_id, 1::BIGINT AS run,
    (1 + o_orderkey // 1000)::BIGINT AS lumi, (o_orderkey + 1)::BIGINT AS event, 0 AS jet_index,
    {PFN.format(r='(18000 + c_nationkey)', f='(o_custkey % 8)')} AS canonical_pfn,
    {ROLE.format(n='c_nationkey')} AS role,
    (CASE WHEN c_nationkey % 5 = 0 THEN 1 ELSE 0 END)::TINYINT AS target,
    (400 + floor(o_totalprice)::BIGINT % 700)::FLOAT AS jet_pt,
    ((o_orderkey % 500 - 250) / 100.0::DOUBLE)::FLOAT AS jet_eta,
    ((o_orderkey % 629 - 314) / 100.0::DOUBLE)::FLOAT AS jet_phi,
    ((o_custkey % 21 - 10) / 10.0::DOUBLE)::FLOAT AS pv_z,
    (5 + o_custkey % 40)::INTEGER AS n_vertices
  FROM orders JOIN customer ON o_custkey = c_custkey),
jets AS (
  SELECT *, sha256(canonical_pfn) AS pfn_sha256,
    {bucket10('sha256(canonical_pfn)')} AS bucket,
    {split_of('sha256(canonical_pfn)')} AS split,
    'cms:' || record_id || ':' || sha256(canonical_pfn) || ':' || run || ':' || lumi || ':'
      || event || ':' || jet_index AS jet_id
  FROM raw_jets)"""

MANIFEST = f"""manifest AS (
  SELECT (18000 + n_nationkey)::BIGINT AS record_id, file_no,
    {PFN.format(r='(18000 + n_nationkey)', f='file_no')} AS canonical_pfn,
    substr(sha256((18000 + n_nationkey) || '-' || file_no), 1, 8) AS adler32,
    (1000 + 18000 + n_nationkey + file_no)::BIGINT AS size_bytes
  FROM nation, range(8) AS t(file_no))"""

ORD = (
    "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, "
    "l_tax, l_returnflag, l_linestatus"
)

PARTICLES = f"""particles AS (
  SELECT l_orderkey AS o_orderkey, {ORD},
    l_extendedprice / 1000.0::DOUBLE AS pt,
    (l_suppkey % 500 - 250) / 100.0::DOUBLE AS eta,
    (l_partkey % 629 - 314) / 100.0::DOUBLE AS phi,
    (l_extendedprice / 1000.0::DOUBLE) * (1.0::DOUBLE + l_tax) AS energy,
    CASE l_returnflag WHEN 'R' THEN -1.0::DOUBLE WHEN 'A' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
      AS charge,
    ([211, 22, 130, 11, 13, 321, 2112, 310, 999])[(l_suppkey % 9 + 1)::INTEGER] AS pdg_id,
    l_quantity / 1000.0::DOUBLE AS dxy, l_quantity / 10000.0::DOUBLE AS dxy_error,
    l_tax / 10.0::DOUBLE AS dz, l_discount / 10.0::DOUBLE AS dz_error,
    (l_linestatus = 'F') AS has_track
  FROM lineitem),
kept AS (
  SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY pt DESC, {ORD}) - 1 AS idx
  FROM particles WHERE pt >= 10 AND energy >= 10)"""

CANONICAL = f"""{JETS}, {PARTICLES}, canonical AS MATERIALIZED (
  SELECT j.*, k.idx,
    (k.eta - j.jet_eta::DOUBLE)::FLOAT AS delta_eta,
    ({wrap('k.phi - j.jet_phi::DOUBLE')})::FLOAT AS delta_phi,
    ln(k.pt)::FLOAT AS log_pt, ln(k.energy)::FLOAT AS log_energy, k.charge::FLOAT AS charge,
    (CASE WHEN has_track THEN dxy ELSE 0 END)::FLOAT AS dxy_raw,
    (CASE WHEN has_track THEN dxy_error ELSE 0 END)::FLOAT AS dxy_error_raw,
    (CASE WHEN has_track THEN dz ELSE 0 END)::FLOAT AS dz_raw,
    (CASE WHEN has_track THEN dz_error ELSE 0 END)::FLOAT AS dz_error_raw,
    CASE WHEN abs(pdg_id) = 11 THEN 4 WHEN abs(pdg_id) = 13 THEN 5 WHEN abs(pdg_id) = 22 THEN 3
      WHEN abs(pdg_id) IN (130, 310, 2112) THEN 2 WHEN abs(pdg_id) IN (211, 321, 2212) THEN 1
      ELSE 0 END AS pid_type,
    CASE WHEN has_track THEN 1 WHEN charge = 0 THEN 2 ELSE 3 END AS track_state
  FROM jets j JOIN kept k USING (o_orderkey) WHERE k.idx < 150)"""

FIELDS = (
    "delta_eta",
    "delta_phi",
    "log_pt",
    "log_energy",
    "charge",
    "dxy_raw",
    "dxy_error_raw",
    "dz_raw",
    "dz_error_raw",
)
FIT = "fit AS MATERIALIZED (SELECT {} FROM canonical WHERE split = 'train')".format(
    ", ".join(
        f"avg({f}::DOUBLE)::FLOAT AS loc_{f}, "
        f"CASE WHEN stddev_pop({f}::DOUBLE) = 0 THEN 1 ELSE stddev_pop({f}::DOUBLE) END::FLOAT "
        f"AS scale_{f}"
        for f in FIELDS
    )
)


def fitted(field: str) -> str:
    """Location and scale of the train rows beside every row."""
    x = f"{field}::DOUBLE"
    mean, deviation = (f"{f}({x}) FILTER (split = 'train') OVER ()" for f in ("avg", "stddev_pop"))
    return (
        f"({mean})::FLOAT AS loc_{field}, "
        f"(CASE WHEN {deviation} = 0 THEN 1 ELSE {deviation} END)::FLOAT AS scale_{field}"
    )


SCORES = f"""{JETS}, scores AS (
  SELECT run_id, jet_id, split, target,
    (7 * (('0x' || substr(md5(run_id || '|' || jet_id), 1, 6))::BIGINT % 1000)
      + shift * target) / 10000.0::DOUBLE AS score
  FROM jets, (VALUES ('A', 500), ('B', 1000), ('C', 1500), ('D', 2000)) AS c(run_id, shift))"""


def roc(source: str, keys: str, where: str = "TRUE") -> str:
    """CTEs ``g`` (tie groups with running sums) for one or more runs in ``source``."""
    return f"""tie AS (
  SELECT {keys}, score, count(*)::BIGINT AS n, sum(target)::BIGINT AS p
  FROM {source} WHERE {where} GROUP BY {keys}, score),
g AS (
  SELECT *, sum(n) OVER w - n AS c_before, sum(p) OVER w - p AS p_before,
    sum(n) OVER (PARTITION BY {keys}) AS n_all, sum(p) OVER (PARTITION BY {keys}) AS p_all
  FROM tie WINDOW w AS (PARTITION BY {keys} ORDER BY score))"""


AUC = (
    "CASE WHEN max(p_all) > 0 AND max(n_all) > max(p_all) THEN "
    "(sum(p * (c_before + (n + 1) / 2.0::DOUBLE)) - max(p_all) * (max(p_all) + 1) / 2.0::DOUBLE)"
    " / (max(p_all)::DOUBLE * (max(n_all) - max(p_all))) END"
)


def eff_b(eps: float) -> str:
    """Background efficiency at signal efficiency ``eps`` from ``g``."""
    tpr = "((p_all - p_before) / p_all::DOUBLE)"
    tpr0 = "((p_all - p_before - p) / p_all::DOUBLE)"
    neg = "(n_all - p_all)::DOUBLE"
    fpr = f"((n_all - p_all - (c_before - p_before)) / {neg})"
    fpr0 = f"((n_all - p_all - (c_before - p_before) - (n - p)) / {neg})"
    e = f"{eps}::DOUBLE"
    return (
        f"max(CASE WHEN p_all > 0 AND n_all > p_all AND {tpr} >= {e} AND {tpr0} < {e} THEN "
        f"CASE WHEN {tpr} = {e} THEN {fpr} ELSE "
        f"{fpr0} + ({e} - {tpr0}) / ({tpr} - {tpr0}) * ({fpr} - {fpr0}) END END)"
    )


def rank_of(seed: str, ident: str) -> str:
    return f"sha256({seed} || chr(0) || {ident})"
