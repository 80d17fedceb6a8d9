"""Signal contracts, quality limits, the grid of corruptions, spectra, resampling and attribution maps."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalspark.operators import cases as cs
from evalspark.operators import limits as li
from evalspark.operators.attributions import attribution_similarity
from evalspark.operators.spectra import BANDS, FLOOR, HIGH, MAINS, MAINS_HALF, WANDER, filter_taps, resample, spectral_ratios
from evalspark.operators.waves import doubles
from evalspark.plans.fixtures import fixture, with_fixtures
from evalspark.plans.scratch import materialise

NAMES = tuple(f"L{i}" for i in range(12))
CONTRACT = li.Contract(leads=NAMES, n_samples=64, fs=100.0, seconds=0.64)
#: The published presets, but for the limits on high frequencies: the fixture's samples are as rough as noise.
RULES = {name: tuple((*r[:3], 0.75, 0.9) if r[1] == "high" else r for r in rules) for name, rules in li.PRESETS.items()}
#: Masks, shifts and drops of the grid fit 64 samples; masks of 100 and 200 cover all.
GRID = cs.GRID


def _odd_records(spark, d):
    """The fixture with a fault of its own in seven of eight records."""
    k = F.col("record_id") % 8
    name = F.when((k == 1) & (F.col("lead_idx") == 3), "X9").when((k == 2) & (F.col("lead_idx") == 5), "L4")
    name = name.when((k == 3) & (F.col("lead_idx") < 2), F.concat(F.lit("L"), (1 - F.col("lead_idx")).cast("string"))).otherwise(F.col("lead_name"))
    samples = F.when((F.col("record_id") % 16 == 8) & (F.col("lead_idx") == 2), F.transform("samples", lambda v, i: F.when(i != 4, v))).otherwise(F.col("samples"))
    return fixture(spark, d, "wave").where("NOT (record_id % 8 = 7 AND lead_idx = 11)").select(
        "record_id", "lead_idx", name.alias("lead_name"), F.when(k == 5, 50.0).otherwise(F.col("fs")).alias("fs"),
        F.when(k == 6, 1.0).otherwise(0.64).alias("seconds"), F.when((k == 4) & (F.col("lead_idx") == 7), "uV").otherwise("mV").alias("unit"), samples.alias("samples"),
    )


def q1_contract_issues(spark, d):
    out = li.contract_issues(_odd_records(spark, d), CONTRACT)
    return out.select("record_id", *[F.array_join(c, ",").alias(c) for c in ("issues", "missing", "unexpected")])


def _rates(spark, d):
    rate = F.element_at(F.array(*[F.lit(x) for x in (100.0, 125.0, 12.5)]), (F.col("lead_idx") % 3 + 1).cast("int"))
    return fixture(spark, d, "wave").withColumn("fs", rate)


def q3_spectral_ratios(spark, d):
    rows = _rates(spark, d).select("record_id", "lead_idx", spectral_ratios(F.col("samples"), F.col("fs")).alias("r"))
    return rows.select("record_id", "lead_idx", *[F.round(f"r.{b}", 6).alias(b) for b in BANDS])


def q8_resample(spark, d):
    """Every sample at three fifths and at one fifth of the rate."""
    wave = fixture(spark, d, "wave")
    parts = [wave.select("record_id", "lead_idx", F.lit(f"{up}/{down}").alias("rate"), F.posexplode(resample(F.col("samples"), up, down)).alias("i", "value")) for up, down in ((3, 5), (1, 5))]
    return parts[0].unionByName(parts[1]).withColumn("value", F.round("value", 6))


def _ecg(spark, d):
    """Records whose limb leads are consistent, some with a flat tail, a copied, an empty or a strong lead."""
    s = lambda i: F.col(f"l{i}")
    held = [F.first(F.when(F.col("lead_idx") == i, doubles(F.col("samples"))), ignorenulls=True).alias(f"l{i}") for i in range(12)]
    rows = fixture(spark, d, "wave").groupBy("record_id").agg(*held)
    z = lambda f: F.zip_with(s(0), s(1), f)
    limb = {2: z(lambda a, b: b - a), 3: z(lambda a, b: -(a + b) / 2), 4: z(lambda a, b: a - b / 2), 5: z(lambda a, b: b - a / 2)}
    k = F.col("record_id")
    chest = {
        7: F.when(k % 5 == 1, F.transform(s(7), lambda v, i: F.when(i < 8, v).otherwise(0.25))).otherwise(s(7)), 8: F.when(k % 5 == 2, s(6)).otherwise(s(8)),
        9: F.when(k % 5 == 3, F.transform(s(9), lambda v: F.lit(0.0))).otherwise(s(9)), 10: F.when(k % 7 == 4, F.transform(s(10), lambda v: v * 20)).otherwise(s(10)),
    }
    leads = F.array(*[(limb | chest).get(i, s(i)) for i in range(12)])
    wide = rows.select("record_id", F.posexplode(leads).alias("lead_idx", "samples")).where("samples IS NOT NULL")
    return wide.select("record_id", "lead_idx", F.concat(F.lit("L"), F.col("lead_idx").cast("string")).alias("lead_name"), F.lit(100.0).alias("fs"), F.lit(0.64).alias("seconds"), F.lit("mV").alias("unit"), "samples")


def q4_preset_findings(spark, d):
    out = li.findings(li.lead_measures(materialise(_ecg(spark, d), "ecg")), li.limit_rows(spark, RULES), ["record_id", "lead_idx"], li.METRICS)
    return out.withColumn("value", F.round("value", 6))


def q7_record_assessment(spark, d):
    out = li.assess_records(materialise(_ecg(spark, d), "ecg"), li.limit_rows(spark, RULES), CONTRACT, li.Reversal(0.1, -0.05, 0.5))
    return out.withColumn("reasons", F.array_join("reasons", ","))


def q10_case_grid(spark, d):
    out = cs.corrupt_cases(_ecg(spark, d), GRID)
    total = lambda f: F.aggregate(F.transform("samples", f), F.lit(0.0), lambda a, v: a + v)
    return out.select("case_id", "record_id", "lead_idx", F.round(total(lambda v, i: v * v), 5).alias("energy"), F.round(total(lambda v, i: v * (i + 1)), 4).alias("placed"))


def q11_stress_matrix(spark, d):
    return cs.stress_matrix(materialise(_ecg(spark, d), "ecg"), li.limit_rows(spark, RULES), CONTRACT, GRID, reversal=li.Reversal(0.1, -0.05, 0.5))


def q16_case_effects(spark, d):
    return cs.case_effects(materialise(_ecg(spark, d), "ecg"), GRID)


def q13_attribution_similarity(spark, d):
    """Each record's leads against those of the next record; some maps are zero, flat, rounded to ties or short of a lead."""
    k = F.col("record_id")
    maps = fixture(spark, d, "wave").select("record_id", "lead_idx", F.transform("samples", lambda v: F.round(v.cast("double") * 4)).alias("r"), doubles(F.col("samples")).alias("s"))
    value = F.when(k % 5 == 0, F.col("r")).when(k % 7 == 1, F.transform("s", lambda v: v * 0)).when(k % 7 == 2, F.transform("s", lambda v: v * 0 + 0.5)).otherwise(F.col("s"))
    a = maps.select("record_id", "lead_idx", value.alias("samples"))
    b = a.where("NOT (record_id % 11 = 3 AND lead_idx = 4)").withColumn("record_id", F.col("record_id") - 1)
    out = attribution_similarity(a, b)
    return out.select("record_id", *[F.round(c, 6).alias(c) for c in ("cosine", "time_cosine")], "time_cosine_valid", F.round("spearman", 6).alias("spearman"), "spearman_valid", "reason")


_FUNCTIONS = (q1_contract_issues, q3_spectral_ratios, q8_resample, q4_preset_findings, q7_record_assessment, q10_case_grid, q11_stress_matrix, q13_attribution_similarity, q16_case_effects)
QUERIES = {f.__name__: f for f in _FUNCTIONS}


def _wave_sql(body: str) -> str:
    return with_fixtures(["wave"], f"WITH {body}")


_S = "list_transform(samples, lambda v: CAST(v AS DOUBLE))"
_LIST = lambda items: "[" + ", ".join(repr(x) for x in items) + "]"
_WANTED = _LIST(NAMES)
_ISSUE_SQL = (
    "uneven OR bad_length", "nonfinite", "uneven", "len(list_distinct(names)) < len(names)", "len(missing) > 0", "len(unexpected) > 0",
    f"len(missing) = 0 AND len(unexpected) = 0 AND names <> {_WANTED}", "bad_fs", "bad_seconds", "bad_unit",
)


def _fold(f: float) -> str:
    return f"least(({f} % fs + fs) % fs, fs - ({f} % fs + fs) % fs)"


def _band_sql(source: str, key: str) -> str:
    """Shares of power of rows (key, fs, s), s of 64 samples, by a Fourier sum."""
    near = [f"abs(f - {_fold(m)}) <= {MAINS_HALF}" for m in MAINS]
    tests = (f"f >= {FLOOR} AND f < {WANDER}", *near, f"f >= {HIGH[0]} AND f <= {HIGH[1]} AND NOT {near[0]} AND NOT {near[1]}")
    return f"""pt AS (SELECT {key}, fs, i, s[i + 1] - list_avg(s) AS v FROM {source}, range(64) r(i)),
pk AS (SELECT k, i, (0.5 - 0.5 * cos(2 * pi() * i / 63)) * cos(2 * pi() * k * i / 64) AS c, (0.5 - 0.5 * cos(2 * pi() * i / 63)) * sin(2 * pi() * k * i / 64) AS d FROM range(33) a(k), range(64) b(i)),
pw AS (SELECT {key}, k * fs / 64 AS f, fs, sum(v * c) ** 2 + sum(v * d) ** 2 AS p FROM pt JOIN pk USING (i) GROUP BY {key}, fs, k),
bands AS (SELECT {key}, {", ".join(f"coalesce(sum(p) FILTER ({t}) / nullif(sum(p) FILTER (f >= {FLOOR}), 0), 0) AS {b}" for b, t in zip(BANDS, tests))} FROM pw GROUP BY {key})"""


def _resample_sql(up: int, down: int) -> str:
    taps = [float(x) for x in filter_taps(up, down)]
    half = (len(taps) - 1) // 2
    n = -(-64 * up // down)
    at = f"{half} + m.i * {down} - k * {up}"
    return f"""SELECT record_id, lead_idx, '{up}/{down}' AS rate, CAST(m.i AS INTEGER) AS i,
  round(list_sum(list_transform(range(64), lambda k: CASE WHEN {at} BETWEEN 0 AND {len(taps) - 1} THEN s[k + 1] * h[{at} + 1] ELSE 0 END)), 6) AS value
FROM (SELECT record_id, lead_idx, {_S} AS s FROM wave), (SELECT {_LIST(taps)} AS h), range({n}) m(i)"""


_ECG = f"""a0 AS (SELECT record_id, lead_idx, {_S} AS s FROM wave), a1 AS (SELECT record_id, {", ".join(f"max(s) FILTER (lead_idx = {i}) AS l{i}" for i in range(12))} FROM a0 GROUP BY 1),
a2 AS (SELECT record_id, [l0, l1, {", ".join(f"list_transform(range(1, 65), lambda i: {e})" for e in ("l1[i] - l0[i]", "-(l0[i] + l1[i]) / 2", "l0[i] - l1[i] / 2", "l1[i] - l0[i] / 2"))}, l6,
  CASE WHEN record_id % 5 = 1 AND l7 IS NOT NULL THEN list_transform(range(1, 65), lambda i: CASE WHEN i <= 8 THEN l7[i] ELSE 0.25 END) ELSE l7 END, CASE WHEN record_id % 5 = 2 THEN l6 ELSE l8 END,
  CASE WHEN record_id % 5 = 3 AND l9 IS NOT NULL THEN list_transform(l9, lambda v: v * 0) ELSE l9 END, CASE WHEN record_id % 7 = 4 AND l10 IS NOT NULL THEN list_transform(l10, lambda v: v * 20) ELSE l10 END, l11] AS ls FROM a1),
ecg AS (SELECT record_id, CAST(i AS INTEGER) AS lead_idx, 100.0 AS fs, ls[i + 1] AS s FROM a2, range(12) r(i) WHERE ls[i + 1] IS NOT NULL)"""


def _measures_sql(source: str, key: str) -> str:
    """measures (key, lead_idx, METRICS) of rows (key, lead_idx, fs, s)."""
    both = f"{key}, lead_idx"
    run = lambda mask: f"list_max(list_transform(string_split(array_to_string(list_transform({mask}), ''), '0'), lambda t: len(t)))"
    return f"""{_band_sql(source, both)},
m0 AS (SELECT {both}, fs, s, list_min(s) AS lo, list_max(s) AS hi, list_transform(range(1, len(s)), lambda i: abs(s[i + 1] - s[i])) AS dd FROM {source}),
m1 AS (SELECT *, {run(f"dd, lambda v: CASE WHEN v <= {li.FLAT_STEP} THEN '1' ELSE '0' END")} AS flat_run, list_filter(s, lambda v: v - lo <= {li.CLIP_NEAR} OR hi - v <= {li.CLIP_NEAR}) AS cl,
  {run(f"s, lambda v: CASE WHEN v - lo <= {li.CLIP_NEAR} OR hi - v <= {li.CLIP_NEAR} THEN '1' ELSE '0' END")} AS cr FROM m0),
measures AS (SELECT {both}, hi - lo AS peak_to_peak, sqrt(list_avg(list_transform(s, lambda v: (v - list_avg(s)) ** 2))) AS sd, greatest(abs(lo), abs(hi)) AS max_abs, len(list_filter(dd, lambda v: v <= {li.FLAT_STEP})) / len(dd) AS flat_fraction,
  CASE WHEN flat_run > 0 THEN (flat_run + 1) / fs ELSE 0.0 END AS flat_seconds, len(cl) / len(s) AS clip_fraction, CAST(cr AS DOUBLE) AS clip_run, list_max(dd) AS max_step, {", ".join(BANDS)} FROM m1 JOIN bands USING ({both}))"""


_RULE_SQL = "rules AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{name}', '{r[0]}', '{r[1]}', '{r[2]}', {'CAST(NULL AS DOUBLE)' if r[3] is None else float(r[3])}, {float(r[4])}, {k})" for name, rules in RULES.items() for k, r in enumerate(rules)
) + ") t(preset, reason, metric, direction, warn, reacquire, place))"


def _findings_sql(key: str) -> str:
    """found (key, lead_idx, preset, reason, rank, metric, value, boundary), from measures and rules."""
    both = f"{key}, lead_idx"
    over = lambda limit: f"CASE WHEN direction = 'above' THEN value >= {limit} ELSE value <= {limit} END"
    return f"""{_RULE_SQL}, lm AS (SELECT {both}, unnest({_LIST(li.METRICS)}) AS metric, unnest([{", ".join(li.METRICS)}]) AS value FROM measures),
hits AS (SELECT *, CASE WHEN {over("reacquire")} THEN 2 WHEN {over("warn")} THEN 1 END AS rank FROM lm JOIN rules USING (metric)),
found AS (SELECT *, CASE WHEN rank = 2 THEN reacquire ELSE warn END AS boundary FROM hits WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {both}, preset, reason ORDER BY rank DESC, place) = 1)"""


def _assess_sql(source: str, key: str) -> str:
    """judged (key, preset, status, allowed, reasons) of rows (key, lead_idx, fs, s) whose other columns keep the contract."""
    leads = ", ".join(f"max(s) FILTER (lead_idx = {i}) AS l{i}" for i in range(12))
    residual = " + ".join(("(l0[i] + l2[i] - l1[i]) ** 2", "(l3[i] + (l0[i] + l1[i]) / 2) ** 2", "(l4[i] - (l0[i] - l1[i] / 2)) ** 2", "(l5[i] - (l1[i] - l0[i] / 2)) ** 2"))
    own = " + ".join(f"l{i}[i] ** 2" for i in range(6))
    corr = lambda a, b: f"coalesce((SELECT CASE WHEN stddev_pop(x) * stddev_pop(y) * 64 > power(2, -52) THEN corr(x, y) ELSE 0 END FROM (SELECT unnest(l{a}) AS x, unnest(l{b}) AS y)), 0) <= -0.05"
    return f"""whole AS (SELECT {key}, count(*) AS n FROM {source} GROUP BY {key}), fine AS (SELECT s.* FROM {source} s JOIN whole w USING ({key}) WHERE n = 12),
{_measures_sql("fine", key)}, {_findings_sql(key)},
wide AS (SELECT {key}, {leads} FROM fine GROUP BY {key}),
limb AS (SELECT {key}, sqrt(list_sum(list_transform(range(1, 65), lambda i: {residual})) / 256) / greatest(sqrt(list_sum(list_transform(range(1, 65), lambda i: {own})) / 384), power(2, -52)) AS r FROM wide),
limb_hits AS (SELECT {key}, preset, reason, CASE WHEN r >= reacquire THEN 2 WHEN r >= warn THEN 1 END AS rank FROM limb JOIN rules ON metric = 'limb_residual'),
flat AS (SELECT {key}, lead_idx, preset FROM found WHERE reason = 'flatline' AND rank = 2), limb_flat AS (SELECT DISTINCT {key}, preset FROM flat WHERE lead_idx < 6),
rest AS (SELECT f.*, preset, reason, reacquire FROM fine f JOIN rules ON metric = 'duplicate_distance' ANTI JOIN flat USING ({key}, lead_idx, preset)),
twins AS (SELECT DISTINCT b.{key}, b.preset, b.reason, 2 AS rank FROM rest b JOIN rest a ON a.{key} = b.{key} AND a.preset = b.preset AND a.lead_idx < b.lead_idx LEFT JOIN limb_flat q ON q.{key} = b.{key} AND q.preset = b.preset
  WHERE NOT (q.{key} IS NOT NULL AND a.lead_idx < 6 AND b.lead_idx < 6) AND list_max(list_transform(range(1, 65), lambda i: abs(a.s[i] - b.s[i]))) <= b.reacquire),
mid AS (SELECT {key}, lead_idx, list_transform(s, lambda v: v - list_median(s)) AS e FROM fine), cut AS (SELECT {key}, lead_idx, list_filter(e, lambda v: abs(v) >= list_aggregate(list_transform(e, lambda z: abs(z)), 'quantile_cont', 0.9)) AS k FROM mid),
pol AS (SELECT {key}, lead_idx, CASE WHEN list_sum(list_transform(k, lambda v: abs(v))) > power(2, -52) THEN list_sum(k) / list_sum(list_transform(k, lambda v: abs(v))) ELSE 0 END AS p FROM cut),
pw2 AS (SELECT {key}, {", ".join(f"max(p) FILTER (lead_idx = {i}) AS p{i}" for i in (0, 1, 3, 5, 10, 11))} FROM pol GROUP BY {key}),
ev AS (SELECT {key}, p0 <= -0.1 AS a1, p3 >= 0.1 AS a2, CAST(p11 >= 0.1 AS INT) + CAST({corr(0, 11)} AS INT) AS a3, p1 <= -0.1 AS b1, p5 <= -0.1 AS b2, CAST(p10 >= 0.1 AS INT) + CAST({corr(1, 10)} AS INT) AS b3 FROM pw2 JOIN wide USING ({key})),
turned AS (SELECT {key} FROM ev WHERE (a1 AND a2 AND (2 + a3) / 4.0 >= 0.5) OR (b1 AND a2 AND b2 AND (3 + b3) / 5.0 >= 0.5)),
presets AS (SELECT DISTINCT preset FROM rules),
every_ AS (SELECT {key}, preset, reason, rank FROM found UNION ALL SELECT * FROM limb_hits WHERE rank IS NOT NULL UNION ALL SELECT * FROM twins UNION ALL SELECT {key}, preset, 'probable_limb_lead_reversal', 2 FROM turned, presets),
worst AS (SELECT {key}, preset, max(rank) AS rank, list_sort(list(DISTINCT reason)) AS reasons FROM every_ GROUP BY {key}, preset),
judged AS (SELECT {key}, preset, ['ACCEPTABLE', 'LIMITED', 'REACQUIRE', 'INVALID'][CASE WHEN n < 12 THEN 3 ELSE coalesce(rank, 0) END + 1] AS status, n = 12 AND coalesce(rank, 0) = 0 AS allowed,
  CASE WHEN n < 12 THEN 'wrong_signal_shape,lead_count_mismatch,missing_leads' ELSE coalesce(array_to_string(reasons, ','), '') END AS reasons FROM whole CROSS JOIN presets LEFT JOIN worst USING ({key}, preset))"""


def _case_sql() -> str:
    """grid (case_id, record_id, lead_idx, fs, s): every record of ecg under every case."""
    rows = ", ".join(f"('{c.case_id}', '{c.kind}', {float(c.amount)}, {float(c.frequency)}, {float(c.phase)}, {list(c.leads)})" for c in GRID)
    draw = lambda *parts: "CAST('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + ")), 1, 8) AS UBIGINT) / 4294967296.0"
    noise = lambda part: draw(f"'{cs.SEED}'", "record_id", "lead_idx", "i", f"'{part}'")
    return f"""kinds AS (SELECT * FROM (VALUES {rows}) t(case_id, kind, amount, freq, phase, leads)),
rec AS (SELECT record_id, greatest(sqrt(sum(list_sum(list_transform(s, lambda v: v * v))) / sum(len(s))), 1e-12) AS rms, {draw(f"'{cs.SEED}'", "record_id", "'mask'")} AS u FROM ecg GROUP BY record_id),
nz AS (SELECT record_id, lead_idx, i, sqrt(-2 * ln(1 - {noise("u")})) * cos(2 * pi() * {noise("v")}) AS z FROM ecg, range(64) r(i)),
nl AS (SELECT record_id, lead_idx, list(z ORDER BY i) AS z FROM nz GROUP BY ALL), nr AS (SELECT record_id, sqrt(sum(z * z) / count(*)) AS zr FROM nz GROUP BY 1),
src AS (SELECT k.*, e.record_id, e.lead_idx, e.fs, rms, u, z, zr, CASE WHEN kind = 'order' THEN (SELECT o.s FROM ecg o WHERE o.record_id = e.record_id AND o.lead_idx = k.leads[e.lead_idx + 1]) ELSE e.s END AS s
  FROM ecg e JOIN rec USING (record_id) JOIN nl USING (record_id, lead_idx) JOIN nr USING (record_id), kinds k),
grid AS (SELECT case_id, record_id, lead_idx, fs, CASE
  WHEN kind = 'tone' THEN list_transform(range(64), lambda i: s[i + 1] + amount * rms * sin(2 * pi() * freq * i / fs + phase))
  WHEN kind = 'noise' THEN list_transform(range(64), lambda i: s[i + 1] + rms / 10.0 ** (amount / 20) / greatest(zr, 1e-12) * z[i + 1])
  WHEN kind = 'scale' THEN list_transform(s, lambda v: v * amount) WHEN kind = 'offset' THEN list_transform(s, lambda v: v + amount * rms)
  WHEN kind = 'shift' THEN list_transform(range(64), lambda i: CASE WHEN i - amount BETWEEN 0 AND 63 THEN s[CAST(i - amount AS INT) + 1] ELSE 0.0 END)
  WHEN kind = 'mask' THEN list_transform(range(64), lambda i: CASE WHEN i >= floor(u * greatest(64 - amount + 1, 1)) AND i < floor(u * greatest(64 - amount + 1, 1)) + amount THEN 0.0 ELSE s[i + 1] END)
  WHEN kind = 'drop' AND list_contains(leads, lead_idx) THEN list_transform(s, lambda v: 0.0) ELSE s END AS s FROM src)"""


_MAPS = f"""mp AS (SELECT record_id, lead_idx, {_S} AS s FROM wave), ma AS (SELECT record_id, lead_idx, CASE WHEN record_id % 5 = 0 THEN list_transform(s, lambda v: round(v * 4)) WHEN record_id % 7 = 1 THEN list_transform(s, lambda v: 0.0) WHEN record_id % 7 = 2 THEN list_transform(s, lambda v: 0.5) ELSE s END AS s FROM mp),
mb AS (SELECT record_id - 1 AS record_id, lead_idx, s FROM ma WHERE NOT (record_id % 11 = 3 AND lead_idx = 4)), ra AS (SELECT record_id, list(lead_idx ORDER BY lead_idx) AS l, list_sort(list(DISTINCT lead_idx)) AS dl FROM ma GROUP BY 1), rb AS (SELECT record_id, list(lead_idx ORDER BY lead_idx) AS l FROM mb GROUP BY 1),
st AS (SELECT record_id, coalesce(ra.l = rb.l, false) AS ok FROM ra FULL JOIN rb USING (record_id)),
ta AS (SELECT record_id, i, avg(abs(s[i])) AS v FROM ma, range(1, 65) r(i) GROUP BY ALL), tb AS (SELECT record_id, i, avg(abs(s[i])) AS v FROM mb, range(1, 65) r(i) GROUP BY ALL),
ka AS (SELECT *, rank() OVER (PARTITION BY record_id ORDER BY v) + (count(*) OVER (PARTITION BY record_id, v) - 1) / 2.0 AS k FROM ta), kb AS (SELECT *, rank() OVER (PARTITION BY record_id ORDER BY v) + (count(*) OVER (PARTITION BY record_id, v) - 1) / 2.0 AS k FROM tb),
tm AS (SELECT record_id, sqrt(sum(a.v * a.v)) AS na, sqrt(sum(b.v * b.v)) AS nb, sum(a.v * b.v) AS ab, sum((a.k - 32.5) ** 2) AS qa, sum((b.k - 32.5) ** 2) AS qb, sum((a.k - 32.5) * (b.k - 32.5)) AS q FROM ka a JOIN kb b USING (record_id, i) GROUP BY 1),
fl AS (SELECT record_id, sqrt(sum(list_dot_product(a.s, a.s))) AS na, sqrt(sum(list_dot_product(b.s, b.s))) AS nb, sum(list_dot_product(a.s, b.s)) AS ab FROM ma a JOIN mb b USING (record_id, lead_idx) GROUP BY 1)"""

ORACLE_SQL = {
    "q1_contract_issues": _wave_sql(f"""o AS (SELECT record_id, lead_idx, record_id % 8 AS k, fs, samples, CASE WHEN record_id % 8 = 1 AND lead_idx = 3 THEN 'X9' WHEN record_id % 8 = 2 AND lead_idx = 5 THEN 'L4' WHEN record_id % 8 = 3 AND lead_idx < 2 THEN 'L' || CAST(1 - lead_idx AS VARCHAR) ELSE lead_name END AS name
  FROM wave WHERE NOT (record_id % 8 = 7 AND lead_idx = 11)),
g AS (SELECT record_id, list(name ORDER BY lead_idx) AS names, bool_or(len(samples) <> 64) AS bad_length, bool_or(record_id % 16 = 8 AND lead_idx = 2) AS nonfinite, bool_or(k = 5) AS bad_fs, bool_or(k = 6) AS bad_seconds, bool_or(k = 4 AND lead_idx = 7) AS bad_unit FROM o GROUP BY record_id),
x AS (SELECT *, len(names) <> 12 AS uneven, list_sort(list_filter({_WANTED}, lambda n: NOT list_contains(names, n))) AS missing, list_sort(list_distinct(list_filter(names, lambda n: NOT list_contains({_WANTED}, n)))) AS unexpected FROM g)
SELECT record_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {t} THEN '{c}' END" for c, t in zip(li.ISSUES, _ISSUE_SQL))}], lambda r: r IS NOT NULL), ',') AS issues, array_to_string(missing, ',') AS missing, array_to_string(unexpected, ',') AS unexpected FROM x"""),
    "q3_spectral_ratios": _wave_sql(f"z AS (SELECT record_id, lead_idx, [100.0, 125.0, 12.5][lead_idx % 3 + 1]::DOUBLE AS fs, {_S} AS s FROM wave), {_band_sql('z', 'record_id, lead_idx')} SELECT record_id, lead_idx, {', '.join(f'round({b}, 6) AS {b}' for b in BANDS)} FROM bands"),
    "q8_resample": with_fixtures(["wave"], f"{_resample_sql(3, 5)} UNION ALL {_resample_sql(1, 5)}"),
    "q4_preset_findings": _wave_sql(f"""{_ECG}, {_measures_sql("ecg", "record_id")}, {_findings_sql("record_id")}
SELECT record_id, lead_idx, preset, reason, ['ACCEPTABLE', 'LIMITED', 'REACQUIRE'][rank + 1] AS status, metric, round(value, 6) AS value, boundary FROM found"""),
    "q7_record_assessment": _wave_sql(f"{_ECG}, {_assess_sql('ecg', 'record_id')} SELECT record_id, preset, status, allowed, reasons FROM judged"),
    "q10_case_grid": _wave_sql(f"{_ECG}, {_case_sql()} SELECT case_id, record_id, lead_idx, round(list_sum(list_transform(s, lambda v: v * v)), 5) AS energy, round(list_sum(list_transform(range(1, 65), lambda i: s[i] * i)), 4) AS placed FROM grid"),
    "q11_stress_matrix": _wave_sql(f"""{_ECG}, {_case_sql()}, keyed AS (SELECT struct_pack(c := case_id, r := record_id) AS id, lead_idx, fs, s FROM grid), {_assess_sql('keyed', 'id')}
SELECT id.c AS case_id, preset, count(*) FILTER (status = 'ACCEPTABLE') AS acceptable, count(*) FILTER (status = 'LIMITED') AS limited, count(*) FILTER (status = 'REACQUIRE') AS reacquire, count(*) FILTER (status = 'INVALID') AS invalid,
count(*) FILTER (allowed AND id.c <> 'clean') AS fail_open FROM judged GROUP BY ALL"""),
    "q16_case_effects": _wave_sql(f"""{_ECG}, {_case_sql()}, fp AS (SELECT case_id, record_id, string_agg(array_to_string(list_transform(s, lambda v: CAST(CAST(round(v * 1e6) AS BIGINT) AS VARCHAR)), ','), '|' ORDER BY lead_idx) AS p FROM (
  SELECT * FROM grid UNION ALL SELECT '' AS case_id, record_id, lead_idx, fs, s FROM ecg) GROUP BY ALL),
pl AS (SELECT fp.*, list_position({_LIST(c.case_id for c in GRID)}, case_id) AS place FROM fp WHERE case_id <> ''), e AS (SELECT pl.record_id, pl.case_id, pl.p = o.p AS same, place, min(struct_pack(place := place, case_id := pl.case_id)) OVER (PARTITION BY pl.record_id, pl.p) AS f FROM pl JOIN fp o ON o.record_id = pl.record_id AND o.case_id = '')
SELECT record_id, case_id, CASE WHEN same THEN 'no_op' WHEN f.place < place THEN 'duplicate' ELSE 'changed' END AS effect, CASE WHEN NOT same AND f.place < place THEN f.case_id END AS same_as FROM e"""),
    "q13_attribution_similarity": _wave_sql(f"""{_MAPS} SELECT record_id, CASE WHEN ok THEN round(CASE WHEN fl.na <= 1e-12 AND fl.nb <= 1e-12 THEN 1.0 ELSE fl.ab / greatest(fl.na * fl.nb, 1e-12) END, 6) END AS cosine,
CASE WHEN ok THEN round(CASE WHEN tm.na > 1e-12 AND tm.nb > 1e-12 THEN tm.ab / (tm.na * tm.nb) ELSE 0.0 END, 6) END AS time_cosine, CASE WHEN ok THEN tm.na > 1e-12 AND tm.nb > 1e-12 END AS time_cosine_valid,
CASE WHEN ok THEN round(CASE WHEN qa > 1e-12 AND qb > 1e-12 THEN q / sqrt(qa * qb) ELSE 0.0 END, 6) END AS spearman, CASE WHEN ok THEN qa > 1e-12 AND qb > 1e-12 END AS spearman_valid, CASE WHEN NOT ok THEN 'unmatched' END AS reason FROM st LEFT JOIN tm USING (record_id) LEFT JOIN fl USING (record_id)"""),
}
