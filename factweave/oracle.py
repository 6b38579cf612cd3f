"""DuckDB SQL for the registered queries: the same results said independently of Spark."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

from factweave.functions.numbers import characters
from factweave.operators.binding import CAUSAL, MAGNITUDE, MARKUP, PROSE, REASONS, REQUIRED, SEVERITIES
from factweave.operators.facts import LABELS
from factweave.plans.calendar import SUNDAY, ReportPlan
from factweave.queries import BROKEN, EVENT_PLAN, FILE_ROWS, GAPS, HALF, HISTORY, LONG_PLAN, PLAN, PIECE, PLANTED, REGISTRY, SHAPES, STRAYS, UNTRUSTED


def _day(d) -> str:
    return f"DATE '{d.isoformat()}'"


def _values(rows: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({r})" for r in rows) + ")"


def _days_of(plan) -> str:
    return _values([_day(SUNDAY + timedelta(n)) for n in plan.numbers()])


_CELLS = """
cells AS (
  SELECT CAST(o_orderdate AS DATE) AS day, r_name AS region, o_orderpriority AS priority, CAST(count(*) AS DOUBLE) AS sessions,
         CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gmv
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ALL
)"""

_EVENT_CELLS = """
cells AS (
  SELECT CAST(ts AS DATE) AS day, 'u' || user_id % 4 AS bucket, 'h' || CAST(hour(ts) // 6 AS INT) AS part, CAST(count(*) AS DOUBLE) AS sessions,
         CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS orders,
         CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (event_type = 'purchase'), 0) AS DOUBLE) AS gmv
  FROM events GROUP BY ALL
)"""

_SPARSE = """
cells AS (
  SELECT CAST(o_orderdate AS DATE) AS day, 'n' || c_nationkey AS region, 'all' AS priority, CAST(count(*) AS DOUBLE) AS sessions,
         CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gmv
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY ALL
)"""


@dataclass(frozen=True)
class Source:
    """Cells, two dimensions and a plan, from which the statements below are built."""

    cells: str
    plan: ReportPlan
    dims: tuple[str, str]

    def pairs(self, name: str, spans, count: int) -> str:
        rows = [f"'{s.label}', '{b.label}'" for s in spans for b in s.earlier(count)]
        return f"{name} AS (SELECT * FROM {_values(rows)} AS t(label, base))"

    @property
    def periods(self) -> str:
        rows = [f"'{s.label}', '{s.kind}', {_day(s.start)}, {_day(s.end)}, '{s.phrase}'" for s in self.plan.spans()]
        return f"periods AS (SELECT * FROM {_values(rows)} AS t(label, kind, first_day, last_day, phrase))"

    @property
    def records(self) -> str:
        x, y = self.dims
        return f"""WITH {self.cells}, {self.periods}, sums AS (
  SELECT label, {x}, {y}, grouping({x}) AS g1, grouping({y}) AS g2, sum(CAST(sessions AS DECIMAL(30,6))) AS sessions,
         sum(CAST(orders AS DECIMAL(30,6))) AS orders, sum(CAST(gmv AS DECIMAL(30,6))) AS gmv
  FROM cells JOIN periods ON day BETWEEN first_day AND last_day GROUP BY GROUPING SETS ((label), (label, {x}), (label, {y}))
), seg AS (
  SELECT label, CASE WHEN g1 = 0 THEN '{x}' WHEN g2 = 0 THEN '{y}' END AS cut_dim, CASE WHEN g1 = 0 THEN {x} WHEN g2 = 0 THEN {y} END AS cut_value,
         CASE WHEN g1 = 0 THEN '{x}=' || {x} WHEN g2 = 0 THEN '{y}=' || {y} ELSE 'overall' END AS cut, sessions, orders, gmv FROM sums
), universe AS (SELECT DISTINCT cut, cut_dim, cut_value FROM seg
), grid AS (
  SELECT u.cut, u.cut_dim, u.cut_value, p.label, s.cut IS NULL AS filled, CAST(coalesce(s.sessions, 0) AS DOUBLE) AS sessions,
         CAST(coalesce(s.orders, 0) AS DOUBLE) AS orders, CAST(coalesce(s.gmv, 0) AS DOUBLE) AS gmv
  FROM universe u CROSS JOIN periods p LEFT JOIN seg s ON s.cut = u.cut AND s.label = p.label
), rec AS ({" UNION ALL ".join(_metric(i, m) for i, m in enumerate(REGISTRY.metrics))})"""

    @property
    def week(self) -> str:
        plan = self.plan
        return f"""{self.records}, {self.pairs('week_pairs', [plan.week], plan.weeks_back)}, base AS (
  SELECT b.metric_id, b.cut, count(b.value) AS n, avg(b.value) AS mean,
         CASE WHEN count(b.value) > 1 THEN CASE WHEN max(b.value) = min(b.value) THEN 0 ELSE stddev_samp(b.value) END END AS sd, bool_and(b.filled) AS all_filled
  FROM week_pairs JOIN rec b ON b.label = base GROUP BY ALL
), week AS (
  SELECT c.*, p.value AS prior, p.numerator AS prior_num, p.denominator AS prior_den, c.value - p.value AS wow_delta, (c.value - p.value) / nullif(abs(p.value), 0) * 100 AS wow_pct,
         n, mean, sd, (c.value - mean) / nullif(abs(mean), 0) * 100 AS pct, (c.value - mean) / nullif(sd, 0) AS z, c.filled AS gone, NOT c.filled AND all_filled AS fresh,
         {_BASE_FLAGS.format(value='c.value')} AS base_flags,
         CASE WHEN c.statistic = 'rate' THEN CASE WHEN c.denominator <= 0 THEN 'no_exposure' ELSE concat_ws(',', CASE WHEN c.denominator < 30 THEN 'small_denominator' END,
              CASE WHEN least(c.numerator, c.denominator - c.numerator) < 5 THEN 'small_cell' END) END ELSE '' END AS adequacy
  FROM rec c JOIN base USING (metric_id, cut) JOIN rec p ON p.metric_id = c.metric_id AND p.cut = c.cut AND p.label = '{plan.earlier_weeks[0].label}'
  WHERE c.label = '{plan.week.label}'
), shared AS (
  SELECT w.*, CASE WHEN w.cut_dim IS NOT NULL AND w.statistic IN ('count', 'sum') THEN w.wow_delta / nullif(o.wow_delta, 0) * 100 END AS share, (w.numerator + w.prior_num) / nullif(w.denominator + w.prior_den, 0) AS pooled
  FROM week w JOIN week o ON o.metric_id = w.metric_id AND o.cut = 'overall'
), rated AS (
  SELECT *, CASE WHEN denominator > 0 AND prior_den > 0 AND pooled > 0 AND pooled < 1 THEN (numerator / denominator - prior_num / prior_den) / sqrt(pooled * (1 - pooled) * (1 / denominator + 1 / prior_den)) END AS rate_z FROM shared
)"""

    @property
    def days(self) -> str:
        return f"""{self.pairs('day_pairs', self.plan.days, self.plan.days_back)}, med AS (
  SELECT label, b.metric_id, b.cut, count(b.value) AS n, median(b.value) AS m, mad(b.value) AS mad FROM day_pairs JOIN (SELECT metric_id, cut, label AS base, value FROM rec) b USING (base) GROUP BY ALL
), sized_days AS (
  SELECT r.*, p.last_day AS day, n, m, mad, m = 0 AND mad = 0 AS zero, mad * 1.4826 AS wide, CASE WHEN metric_type = 'count' THEN sqrt(greatest(m, 1)) ELSE abs(m) * 0.01 END AS floor
  FROM med JOIN rec r USING (label, metric_id, cut) JOIN periods p USING (label)
), scaled AS (
  SELECT *, CASE WHEN NOT zero AND greatest(wide, floor) > 0 THEN greatest(wide, floor) END AS scale, CASE WHEN NOT zero AND greatest(wide, floor) > 0 THEN (value - m) / greatest(wide, floor) END AS score,
       concat_ws(',', CASE WHEN n < 3 THEN 'thin_baseline' END, CASE WHEN n = 0 THEN 'no_baseline' END, CASE WHEN zero THEN 'all_zero_baseline' END, CASE WHEN zero AND value <> 0 THEN 'new_event' END,
                 CASE WHEN NOT zero AND floor > wide THEN 'scale_floored' END, CASE WHEN NOT zero AND greatest(wide, floor) <= 0 THEN 'degenerate_scale' END,
                 CASE WHEN NOT zero AND greatest(wide, floor) > 0 AND value IS NULL THEN 'no_current_value' END) AS day_flags
  FROM sized_days
)"""

    @property
    def slices(self) -> str:
        return f"""{self.pairs('part_pairs', [self.plan.running], self.plan.weeks_back)}, slice_base AS (
  SELECT b.metric_id, b.cut, count(b.value) AS n, avg(b.value) AS mean, CASE WHEN count(b.value) > 1 THEN CASE WHEN max(b.value) = min(b.value) THEN 0 ELSE stddev_samp(b.value) END END AS sd
  FROM part_pairs JOIN rec b ON b.label = base GROUP BY ALL
), slices AS (
  SELECT rec.*, mean, (value - mean) / nullif(abs(mean), 0) * 100 AS pct, {_BASE_FLAGS.format(value='value')} AS base_flags FROM rec JOIN slice_base USING (metric_id, cut) WHERE label = '{self.plan.running.label}'
)"""

    @property
    def facts(self) -> str:
        """All published numbers: series, k (statistic), label, value, unit, decimals, flags, inputs."""
        plan = self.plan
        week, part = f"'{plan.week.label}'", f"'{plan.running.label}'"
        own = "metric_id || '/' || cut || '/'"
        values = lambda spans: "[" + ", ".join(f"{own} || '{x.label}/value'" for x in spans) + "]"
        now, before, both = values([plan.week]), values(plan.earlier_weeks), values([plan.week, *plan.earlier_weeks[:1]])
        sliced, day_before = values(plan.earlier_slices), f"list_transform((SELECT list(base) FROM day_pairs d WHERE d.label = scaled.label), lambda b: {own} || b || '/value')"
        day_own, points = f"[{own} || label || '/value']", "CASE WHEN unit = 'percent' THEN 'pp' ELSE unit END"
        ratio, rate = "statistic IN ('rate', 'mean')", "statistic = 'rate'"
        parts = [
            ("rec JOIN periods USING (label)", "value", "label", "value", "unit", "decimals", "flags", "['source_rows:' || CASE WHEN first_day = last_day THEN '' ELSE first_day || '..' END || last_day]", "TRUE"),
            ("rated", "n_obs", week, "n_obs", "'count'", "0", "''", "['source_rows:']", "TRUE"), ("rated", "wow_delta", week, "wow_delta", points, "decimals", "''", both, "TRUE"),
            ("rated", "wow_pct", week, "wow_pct", "'percent'", "1", "''", both, "TRUE"), ("rated", "baseline_mean", week, "mean", "unit", "decimals", "base_flags", before, "TRUE"),
            ("rated", "vs_baseline_pct", week, "pct", "'percent'", "1", "base_flags", f"{now} || {before}", "TRUE"), ("rated", "screening_z", week, "z", "'score'", "2", "base_flags", f"{now} || {before}", "TRUE"),
            ("rated", "numerator", week, "numerator", "'count'", "0", "adequacy", "['source_rows:']", ratio), ("rated", "denominator", week, "denominator", "'count'", "0", "adequacy", "['source_rows:']", ratio),
            ("rated", "rate_z", week, "rate_z", "'score'", "2", "adequacy", both, rate),
            ("rated", "contribution_share_pct", week, "share", "'percent'", "1", "''", f"[{own} || {week} || '/wow_delta', metric_id || '/overall/' || {week} || '/wow_delta']", f"cut_dim IS NOT NULL AND NOT {ratio}"),
            ("scaled", "weekday_median", "label", "m", "unit", "decimals", "day_flags", day_before, "TRUE"), ("scaled", "robust_scale", "label", "scale", "unit", "decimals", "day_flags", day_before, "TRUE"),
            ("scaled", "robust_score", "label", "score", "'score'", "2", "day_flags", f"{day_own} || {day_before}", "TRUE"),
            ("slices", "slice_baseline_mean", part, "mean", "unit", "decimals", "base_flags", sliced, "TRUE"),
            ("slices", "vs_slice_pct", part, "pct", "'percent'", "1", "base_flags", f"{values([plan.running])} || {sliced}", "TRUE"),
        ]
        rows = " UNION ALL ".join(
            f"SELECT metric_ord, metric_id, cut, cut_dim, cut_value, '{k}' AS k, {label} AS label, {v} AS v, {unit} AS unit, {decimals} AS decimals, {flags} AS flags, {inputs} AS inputs FROM {table} WHERE {keep}"
            for table, k, label, v, unit, decimals, flags, inputs, keep in parts)
        return f"""{self.week}, {self.days}, {self.slices}, plain_facts AS ({rows}), facts AS (
  SELECT *, metric_id || '/' || cut || '/' || label || '/' || k AS id, {_DISPLAY} AS display FROM plain_facts
)"""

    @property
    def listed(self) -> str:
        return f"""sized AS (
  SELECT *, round(coalesce(abs(z), 0), 6) AS az, round(coalesce(abs(CASE WHEN statistic IN ('rate', 'mean') THEN wow_pct ELSE share END), 0), 6) AS impact FROM shared
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY metric_id, cut_dim ORDER BY az DESC, cut) AS zp, row_number() OVER (PARTITION BY metric_id, cut_dim ORDER BY impact DESC, cut) AS ip FROM sized WHERE cut_dim IS NOT NULL
), chosen AS (
  SELECT *, concat_ws(',', CASE WHEN ip <= 2 AND impact > 0 AND statistic IN ('count', 'sum') THEN 'contribution_share_pct' END, CASE WHEN gone THEN 'disappeared' END,
            CASE WHEN fresh AND NOT gone THEN 'newly_appeared' END, CASE WHEN zp <= 2 AND az > 0 THEN 'screening_z' END,
            CASE WHEN ip <= 2 AND impact > 0 AND statistic IN ('rate', 'mean') THEN 'wow_pct' END) AS channels FROM placed
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY metric_id, cut_dim ORDER BY length(channels) - length(replace(channels, ',', '')) DESC, az DESC, cut) AS place FROM chosen WHERE channels <> ''
), in_order AS (
  SELECT metric_ord, 0 AS dim_ord, 0 AS place, metric_id, cut, 'overall' AS channels FROM week WHERE cut = 'overall'
  UNION ALL SELECT metric_ord, CASE cut_dim WHEN '{self.dims[0]}' THEN 1 ELSE 2 END, place, metric_id, cut, channels FROM kept WHERE place <= 4
), listed AS (SELECT *, CAST(row_number() OVER (ORDER BY metric_ord, dim_ord, place) AS INT) AS rank FROM in_order)"""

    @property
    def packed(self) -> str:
        """The facts of listed series that travel, in order of mention."""
        plan = self.plan
        order = [f"'{k}', '{plan.week.label}', {i}" for i, k in enumerate(_WEEKLY)] + [f"'value', '{plan.earlier_weeks[0].label}', 50"]
        order += [f"'{k}', '{plan.running.label}', {60 + i}" for i, k in enumerate(("value", "slice_baseline_mean", "vs_slice_pct"))]
        daily = [f"'{k}', '{d.label}', {100 + 10 * i + j}" for i, d in enumerate(plan.days) for j, k in enumerate(("value", "weekday_median", "robust_scale", "robust_score"))]
        return f"""travels AS (SELECT *, seq >= 100 AS daily FROM {_values(order + daily)} AS t(k, label, seq)), packed AS (
  SELECT f.*, rank, CAST(row_number() OVER (PARTITION BY rank ORDER BY seq) - 1 AS INT) AS pos
  FROM listed JOIN facts f USING (metric_id, cut) JOIN travels USING (k, label) LEFT JOIN scaled s ON s.metric_id = f.metric_id AND s.cut = f.cut AND s.label = f.label
  WHERE NOT daily OR abs(score) >= 2.5 OR day_flags LIKE '%new_event%'
)"""


def _metric(i: int, m) -> str:
    if m.is_ratio:
        value = f"{m.numerator_field} / nullif({m.denominator_field}, 0){' * 100.0' if m.statistic == 'rate' else ''}"
        den, none = m.denominator_field, f"{m.denominator_field} = 0"
    else:
        value, den, none = m.numerator_field, "CAST(NULL AS DOUBLE)", "FALSE"
    return (
        f"SELECT '{m.id}' AS metric_id, {i} AS metric_ord, '{m.metric_type}' AS metric_type, '{m.statistic}' AS statistic, '{m.unit}' AS unit, {m.display_precision} AS decimals, cut, cut_dim, cut_value, label, "
        f"{value} AS value, {m.numerator_field} AS numerator, {den} AS denominator, "
        f"{m.n_obs_field} AS n_obs, filled, concat_ws(',', CASE WHEN {none} THEN 'no_exposure' END, CASE WHEN filled THEN 'zero_filled' END) AS flags FROM grid"
    )


_BASE_FLAGS = """concat_ws(',', CASE WHEN n < 3 THEN 'thin_baseline' END, CASE WHEN n = 0 THEN 'no_baseline' END, CASE WHEN n > 0 AND {value} IS NULL THEN 'no_current_value' END,
           CASE WHEN n > 0 AND {value} IS NOT NULL AND (sd IS NULL OR sd = 0) THEN 'degenerate_baseline_scale' END)"""
_WEEKLY = ("value", "n_obs", "wow_delta", "wow_pct", "baseline_mean", "vs_baseline_pct", "screening_z", "numerator", "denominator", "rate_z", "contribution_share_pct")


def _shown(x: str) -> str:
    return f"CASE decimals WHEN 0 THEN format('{{:,.0f}}', {x}) WHEN 1 THEN format('{{:,.1f}}', {x}) ELSE format('{{:,.2f}}', {x}) END"


_DISPLAY = f"""CASE WHEN v IS NULL THEN 'n/a' WHEN unit = 'usd' THEN CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || {_shown('abs(v)')}
  ELSE {_shown('v')} || CASE unit WHEN 'percent' THEN '%' WHEN 'pp' THEN 'pp' ELSE '' END END"""

_SHOP = Source(_CELLS, PLAN, ("region", "priority"))
_WEEK = _SHOP.week
_SHORTLIST = f"{_WEEK}, {_SHOP.listed}"
_FACTS = _SHOP.facts
_EVENTS = Source(_EVENT_CELLS, EVENT_PLAN, ("bucket", "part"))

#: A figure and the character before it, as this dialect has no look-behind; a space behind each percent sign parts neighbours.
_RE2_FIGURE = r"(?:^|[^\p{L}\p{N}_.,])([-+−]?\$?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?(?:%|pp)?)"
_RE2_DIGITS = "regexp_replace(replace(replace(replace(replace(raw, '−', '-'), '$', ''), ',', ''), '+', ''), '(%|pp)$', '')"
_RE2_KIND = "CASE WHEN raw LIKE '%pp' THEN 'pp' WHEN raw LIKE '%\\%' ESCAPE '\\' THEN 'percent' WHEN contains(raw, '$') THEN 'usd' ELSE 'bare' END"


def _six(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


_MONEY = "CASE WHEN v < 0 THEN '-' ELSE '' END || '$' || format('{:,.%df}', abs(v))"


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _planted() -> str:
    """Highlights and claims of the planted drafts, and every rule on them."""
    said = lambda t: f"replace(replace({_text(t)}, '{{}}', display), '[]', {_RE2_DIGITS.replace('raw', 'display')})"
    heads = [
        f"SELECT draft_id, {i} AS h, {_text('nope') if i == 3 else 'metric_id'} AS metric_id, {_text('region=NOWHERE') if i == 4 else 'cut'} AS cut, {_text(severity)} AS severity, {_text(title)} AS title, {said(text)} AS narrative FROM drafts"
        for i, (severity, title, text) in enumerate(PLANTED)
    ] + ["SELECT draft_id, 11, 'gmv', 'overall', 'low', 't', 'n' FROM drafts"]
    own = f"draft_id || '/{PLAN.week.label}/value'"
    claims = [(h, 0, own, "v", "drafts") for h in (0, 1, 3, 4, 5, 8)] + [
        (1, 1, own, "v * 2 + 7", "drafts"), (1, 2, "'none/overall/x/value'", "1", "drafts"), (1, 3, f"draft_id || '/{PLAN.earlier_weeks[-1].label}/value'", "0", "drafts"),
        (6, 0, "p.id", "coalesce(p.v, 0)", f"drafts d JOIN packed p USING (metric_id, cut) WHERE p.k = 'value' AND p.label = '{PLAN.earlier_weeks[0].label}'"),
        (7, "row_number() OVER (PARTITION BY draft_id ORDER BY p.id) - 1", "p.id", "0", "drafts d JOIN packed p USING (metric_id, cut) WHERE p.v IS NULL"),
    ]
    kinds = "CASE WHEN unit IN ('usd', 'percent', 'pp') THEN unit ELSE 'bare' END"
    figure = _RE2_FIGURE
    return rf"""{_FACTS}, {_SHOP.listed}, {_SHOP.packed}, drafts AS (
  SELECT metric_id || '/' || cut AS draft_id, metric_id, cut, v, display, p.rank FROM packed p WHERE k = 'value' AND label = '{PLAN.week.label}' AND v IS NOT NULL
), heads AS ({" UNION ALL ".join(heads)}), claims AS (
  {" UNION ALL ".join(f"SELECT draft_id, {h} AS h, CAST({c} AS INT) AS claim, {fact} AS fact_id, CAST({v} AS DOUBLE) AS claimed FROM {rows}" for h, c, fact, v, rows in claims)}
), judged AS (
  SELECT c.*, f.v AS computed, f.display, f.unit, f.label, CASE WHEN f.id IS NULL THEN 'E010' WHEN p.id IS NULL THEN 'E011' WHEN f.v IS NULL THEN 'E013' WHEN abs(claimed - f.v) > 0.5 * pow(10, -f.decimals) THEN 'E012'
         WHEN f.metric_id <> h.metric_id OR f.cut <> h.cut THEN 'E014' END AS code
  FROM claims c JOIN heads h USING (draft_id, h) LEFT JOIN facts f ON f.id = fact_id LEFT JOIN packed p ON p.id = fact_id
), bound AS (SELECT j.*, first_day, last_day, {_RE2_DIGITS.replace('raw', 'display')} AS digits, {kinds} AS own_kind FROM judged j JOIN periods USING (label) WHERE code IS NULL
), prose AS (SELECT draft_id, h, title AS t FROM heads UNION ALL SELECT draft_id, h, narrative FROM heads
), apart AS (SELECT *, replace(regexp_replace(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', ' ', 'g'), '%', '% ') AS a FROM prose
), quoted AS (SELECT draft_id, h, unnest(regexp_extract_all(a, '{figure}', 1)) AS raw FROM apart
), figures AS (SELECT row_number() OVER () AS n, draft_id, h, {_RE2_DIGITS} AS digits, {_RE2_KIND} AS kind FROM quoted
), matched AS (SELECT n, f.draft_id, f.h, count(own_kind) AS hits, count(*) FILTER (own_kind = kind) AS same FROM figures f LEFT JOIN (SELECT DISTINCT draft_id, h, digits, own_kind FROM bound) b USING (draft_id, h, digits) GROUP BY ALL
), quoted_days AS (SELECT draft_id, h, unnest(regexp_extract_all(t, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS day FROM prose
), broken AS (
  SELECT draft_id, h, code FROM judged WHERE code IS NOT NULL
  UNION ALL SELECT draft_id, h, 'E002' FROM heads WHERE metric_id NOT IN ({", ".join(_text(m.id) for m in REGISTRY.metrics)})
  UNION ALL SELECT draft_id, h, 'E003' FROM heads WHERE severity NOT IN ({", ".join(map(_text, SEVERITIES))})
  UNION ALL SELECT draft_id, h, 'E004' FROM heads WHERE metric_id IN ({", ".join(_text(m.id) for m in REGISTRY.metrics)}) AND (metric_id, cut) NOT IN (SELECT (metric_id, cut) FROM packed)
  UNION ALL SELECT draft_id, h, 'E015' FROM bound GROUP BY ALL HAVING NOT bool_or(last_day BETWEEN {_day(PLAN.week.start)} AND {_day(PLAN.latest)})
  UNION ALL SELECT draft_id, h, CASE WHEN hits = 0 THEN 'E020' ELSE 'E023' END FROM matched WHERE same = 0
  UNION ALL SELECT draft_id, h, 'E021' FROM quoted_days q WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.draft_id = q.draft_id AND b.h = q.h AND q.day IN (CAST(first_day AS VARCHAR), CAST(last_day AS VARCHAR)))
  UNION ALL SELECT draft_id, h, 'E022' FROM apart WHERE regexp_matches(regexp_replace(a, '(^|[^\p{{L}}\p{{N}}_.,])[-+−]?\$?(?:[0-9]{{1,3}}(?:,[0-9]{{3}})+|[0-9]+)(?:\.[0-9]+)?(?:%|pp)?', '\1', 'g'), '[0-9]')
  UNION ALL SELECT draft_id, h, 'E024' FROM prose WHERE regexp_matches(t, '(?i)\b({MAGNITUDE})\b')
  UNION ALL SELECT draft_id, h, 'E030' FROM prose WHERE regexp_matches(t, '(?i)\b({CAUSAL})\b')
  UNION ALL SELECT draft_id, h, 'E040' FROM prose WHERE regexp_matches(t, '(?im){MARKUP}')
  UNION ALL SELECT draft_id, unnest([9, 10, 11]), 'E001' FROM drafts
  UNION ALL SELECT draft_id, NULL, 'E050' FROM drafts, (VALUES ('data-quality'), ('whatever'), ('small-absolute-impact')) AS t(reason) WHERE reason NOT IN ({", ".join(map(_text, REASONS))})
  UNION ALL SELECT draft_id, NULL, 'E051' FROM (SELECT draft_id, unnest([999999, 1, rank]) AS named FROM drafts) WHERE named NOT IN (SELECT rank FROM listed)
)"""


def _broken_rows() -> str:
    columns = {"date": "CAST(CAST(ts AS DATE) AS VARCHAR)", "bucket": "event_type", "sessions": "CAST(value AS VARCHAR)"}
    for name, texts in BROKEN.items():
        cases = " ".join(f"WHEN {k} THEN {'NULL' if t is None else _text(t)}" for k, t in texts.items())
        columns[name] = f"CASE event_id % 40 {cases} ELSE {columns[name]} END"
    return ", ".join(f"trim({c}) AS {n}" for n, c in columns.items())


_NUMERIC = r"regexp_full_match(coalesce(sessions, ''), '(?i)[-+]?([0-9]+(\.[0-9]*)?|\.[0-9]+)(e[-+]?[0-9]+)?')"
_ODD = "regexp_full_match(coalesce(sessions, ''), '(?i)[-+]?(nan|inf|infinity)')"
_STALE = f"newest IS NULL OR newest < {_day(PLAN.as_of)} - 2"

_BINDING: dict[str, str] = {
    "claim_binding": f"""{_planted()} SELECT draft_id, h AS highlight, claim, fact_id, CASE code WHEN 'E010' THEN 'dangling' WHEN 'E011' THEN 'not_in_pack' WHEN 'E012' THEN 'mismatch' WHEN 'E013' THEN 'mismatch' WHEN 'E014' THEN 'off_subject' ELSE 'bound' END AS status,
 {_six('claimed', 'claimed')}, {_six('computed', 'computed')} FROM judged""",
    "draft_violations": f"{_planted()} SELECT draft_id, h AS highlight, code, count(*) AS n FROM broken GROUP BY ALL",
    "source_dq_planted": f"""WITH rows AS (SELECT {_broken_rows()}, 'h' || event_id % 40 AS part FROM events), found AS (
  SELECT 'date' AS rule, 'date' AS "column", count(*) AS n FROM rows WHERE date IS NULL OR NOT regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_cast(date AS DATE) IS NULL
  UNION ALL SELECT 'empty_label', 'bucket', count(*) FROM rows WHERE coalesce(bucket, '') = ''
  UNION ALL SELECT 'reserved_label', 'bucket', count(*) FROM rows WHERE starts_with(bucket, '__')
  UNION ALL SELECT 'label_vocabulary', 'bucket', count(*) FROM rows WHERE bucket <> '' AND NOT starts_with(bucket, '__') AND NOT regexp_full_match(bucket, '[A-Za-z0-9][A-Za-z0-9 ._:&+/-]{{0,63}}')
  UNION ALL SELECT 'not_numeric', 'sessions', count(*) FROM rows WHERE NOT {_NUMERIC} AND NOT {_ODD}
  UNION ALL SELECT 'not_finite', 'sessions', count(*) FROM rows WHERE {_ODD} OR ({_NUMERIC} AND NOT coalesce(isfinite(try_cast(sessions AS DOUBLE)), FALSE))
  UNION ALL SELECT 'negative', 'sessions', count(*) FROM rows WHERE {_NUMERIC} AND starts_with(sessions, '-') AND coalesce(try_cast(sessions AS DOUBLE), -1) <> 0
  UNION ALL SELECT 'duplicate_cell', '*', count(*) FROM (SELECT 1 FROM rows GROUP BY date, bucket, part HAVING count(*) > 1)
) SELECT * FROM found WHERE n > 0""",
    "source_first_offence": f"""WITH placed AS (
  SELECT {_broken_rows()}, 'h' || event_id % 40 AS part, event_id, event_id // {FILE_ROWS} AS file, event_id % 1000 = 23 AS head,
         row_number() OVER (PARTITION BY event_id // {FILE_ROWS} ORDER BY event_id) + 1 AS line FROM events
), rows AS (
  SELECT *, row_number() OVER (PARTITION BY date, coalesce(bucket, ''), part ORDER BY file, line) AS turn FROM placed WHERE NOT head AND event_id % 40 <> 21
), heads AS (
  SELECT file, line, row_number() OVER (PARTITION BY file ORDER BY line) AS turn FROM placed WHERE head
), broken AS (
  SELECT 'date' AS rule, 'date' AS "column", file, line FROM rows WHERE date IS NULL OR NOT regexp_full_match(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR try_cast(date AS DATE) IS NULL
  UNION ALL SELECT 'empty_label', 'bucket', file, line FROM rows WHERE coalesce(bucket, '') = ''
  UNION ALL SELECT 'reserved_label', 'bucket', file, line FROM rows WHERE starts_with(bucket, '__')
  UNION ALL SELECT 'label_vocabulary', 'bucket', file, line FROM rows WHERE bucket <> '' AND NOT starts_with(bucket, '__') AND NOT regexp_full_match(bucket, '[A-Za-z0-9][A-Za-z0-9 ._:&+/-]{{0,63}}')
  UNION ALL SELECT 'not_numeric', 'sessions', file, line FROM rows WHERE NOT {_NUMERIC} AND NOT {_ODD}
  UNION ALL SELECT 'not_finite', 'sessions', file, line FROM rows WHERE {_ODD} OR ({_NUMERIC} AND NOT coalesce(isfinite(try_cast(sessions AS DOUBLE)), FALSE))
  UNION ALL SELECT 'negative', 'sessions', file, line FROM rows WHERE {_NUMERIC} AND starts_with(sessions, '-') AND coalesce(try_cast(sessions AS DOUBLE), -1) <> 0
  UNION ALL SELECT 'field_count', '*', file, line FROM rows WHERE event_id % 40 = 22
  UNION ALL SELECT 'duplicate_cell', '*', file, line FROM rows WHERE turn = 2
  UNION ALL SELECT 'repeated_header', '*', file, line FROM heads WHERE turn = 1
) SELECT rule, "column", count(*) AS n, CAST(min(file * 1000000 + line) // 1000000 AS BIGINT) AS file, CAST(min(file * 1000000 + line) % 1000000 AS BIGINT) AS line FROM broken GROUP BY ALL""",
    "coverage_cases": " UNION ALL ".join(f"""SELECT metric_id, CASE WHEN {_STALE} THEN 'stale' WHEN n > 0 THEN 'incomplete' ELSE 'ok' END AS status, required,
       CASE WHEN {_STALE} THEN 'newest day is ' || coalesce(CAST(newest AS VARCHAR), 'missing') WHEN n > 0 THEN n || ' days missing, first ' || first ELSE '' END AS detail, '{case}' AS "case"
FROM {_values([f"'{m.id}', {m.required}" for m in REGISTRY.metrics])} AS t(metric_id, required), (
  WITH {_CELLS}, kept AS (SELECT day FROM cells WHERE NOT coalesce({gone}, FALSE)), days AS (SELECT CAST(d AS DATE) AS day FROM {_days_of(PLAN)} AS t(d))
  SELECT (SELECT max(day) FROM kept) AS newest, count(*) AS n, min(day) AS first FROM days WHERE day NOT IN (SELECT day FROM kept))""" for case, gone in GAPS.items()),
}

ORACLE_SQL = {
    "daily_cells": f"WITH {_CELLS} SELECT day, region, priority, sessions, orders, {_six('gmv', 'gmv')} FROM cells",
    "source_summary": f"WITH {_CELLS} SELECT min(day) AS first_day, max(day) AS last_day, count(*) AS n_rows FROM cells",
    "source_dq": """
WITH rows AS (SELECT event_type, props, value, user_id FROM events)
SELECT 'label_vocabulary' AS rule, 'part' AS "column", count(*) AS n FROM rows WHERE props <> '' AND NOT regexp_full_match(props, '[A-Za-z0-9][A-Za-z0-9 ._:&+/-]{0,63}') HAVING count(*) > 0
UNION ALL SELECT 'duplicate_cell', '*', count(*) FROM (SELECT 1 FROM events GROUP BY CAST(ts AS DATE), event_type, props HAVING count(*) > 1) HAVING count(*) > 0
UNION ALL SELECT 'negative', 'sessions', count(*) FROM rows WHERE value < 0 HAVING count(*) > 0
""",
    "calendar_columns": """
WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, day - CAST(dayofweek(day) AS INT) AS week_start, day - CAST(dayofweek(day) AS INT) + 6 AS week_end, day - 1 AS last_complete_day,
       CASE WHEN dayofweek(day) = 0 THEN day - 7 ELSE day - CAST(dayofweek(day) AS INT) - 7 END AS review_week_start,
       CASE WHEN dayofweek(day) <> 0 THEN day - CAST(dayofweek(day) AS INT) END AS partial_week_start, day - CAST(dayofweek(day) AS INT) - 28 AS fourth_prior_week
FROM days""",
    "week_totals": f"{_SHOP.records} SELECT label AS period_label, cut, CAST(sessions AS DOUBLE) AS sessions, CAST(orders AS DOUBLE) AS orders, {_six('CAST(gmv AS DOUBLE)', 'gmv')} FROM seg WHERE label LIKE 'complete_week%'",
    "segment_universe": f"{_SHOP.records} SELECT cut, cut_dim, cut_value FROM universe",
    "period_grid": f"{_SHOP.records} SELECT metric_id, cut, label AS period_label, {_six('value', 'value')}, {_six('numerator', 'numerator')}, {_six('denominator', 'denominator')}, n_obs, CASE WHEN filled THEN 'zero_fill' ELSE 'query' END AS provenance, flags FROM rec",
    "coverage": f"""WITH {_CELLS}, days AS (SELECT DISTINCT CAST(d AS DATE) AS day FROM {_days_of(PLAN)} AS t(d)),
 gaps AS (SELECT count(*) AS n, min(day) AS first FROM days WHERE day NOT IN (SELECT day FROM cells)), newest AS (SELECT max(day) AS newest FROM cells)
SELECT metric_id, CASE WHEN newest < {_day(PLAN.as_of)} - 2 THEN 'stale' WHEN n > 0 THEN 'incomplete' ELSE 'ok' END AS status, required,
       CASE WHEN newest < {_day(PLAN.as_of)} - 2 THEN 'newest day is ' || newest WHEN n > 0 THEN n || ' days missing, first ' || first ELSE '' END AS detail
FROM {_values([f"'{m.id}', {m.required}" for m in REGISTRY.metrics])} AS t(metric_id, required), gaps, newest""",
    "wow": f"{_WEEK} SELECT metric_id, cut, {_six('value', 'value')}, {_six('wow_delta', 'wow_delta')}, {_six('wow_pct', 'wow_pct')}, n_obs FROM week",
    "baseline_compare": f"{_WEEK} SELECT metric_id, cut, n, {_six('mean', 'baseline_mean')}, {_six('sd', 'baseline_sd')}, {_six('pct', 'vs_baseline_pct')}, {_six('z', 'screening_z')}, base_flags AS flags FROM week",
    "rate_adequacy": f"{_WEEK} SELECT cut, numerator, denominator, adequacy AS flags FROM week WHERE statistic = 'rate'",
    "rate_z": f"{_WEEK} SELECT cut, {_six('rate_z', 'rate_z')} FROM rated WHERE statistic = 'rate'",
    "contribution": f"{_WEEK} SELECT metric_id, cut, {_six('share', 'contribution_share_pct')} FROM shared WHERE cut_dim IS NOT NULL AND statistic IN ('count', 'sum')",
    "daily_robust": f"""{_SHOP.records}, {_SHOP.days}
SELECT metric_id, cut, day, {_six('value', 'value')}, {_six('m', 'weekday_median')}, {_six('mad', 'mad')}, round(scale, 1) + 0.0 AS robust_scale, {_six('score', 'robust_score')}, day_flags AS flags FROM scaled""",
    "partial_slice": f"{_SHOP.records}, {_SHOP.slices} SELECT metric_id, cut, {_six('value', 'value')}, {_six('mean', 'slice_baseline_mean')}, {_six('pct', 'vs_slice_pct')} FROM slices",
    "appeared_disappeared": f"{Source(_SPARSE, PLAN, ('region', 'priority')).week} SELECT cut, value, gone AS disappeared, fresh AS newly_appeared FROM week WHERE metric_id = 'sessions' AND cut_dim = 'region'",
    "fact_ids": f"""{_SHOP.records} SELECT metric_id || '/' || cut || '/' || label || '/value' AS id, first_day AS period_start, last_day AS period_end,
 CASE metric_id WHEN 'gmv' THEN 'usd' WHEN 'aov' THEN 'usd' WHEN 'conversion_rate' THEN 'percent' ELSE 'count' END AS unit, CAST(CASE WHEN metric_id IN ('aov', 'conversion_rate') THEN 2 ELSE 0 END AS INT) AS display_precision
FROM rec JOIN periods USING (label)""",
    "display_format": f"""WITH rows AS (SELECT o_orderkey, o_totalprice AS v FROM orders UNION ALL SELECT -c_custkey, c_acctbal FROM customer)
SELECT o_orderkey, {_MONEY % 0} AS usd0, format('{{:,.2f}}', v) AS plain2, format('{{:,.1f}}', v) || '%' AS percent1,
       CASE WHEN v < 0 THEN '-' ELSE '+' END || format('{{:,.1f}}', abs(v)) || 'pp' AS points1, replace(format('{{:,.2f}}', v), ',', '') AS digits FROM rows""",
    "severity": f"{_WEEK} SELECT metric_id, cut, CASE WHEN abs(wow_pct) >= 20 OR coalesce(abs(z) >= 3, FALSE) THEN 'high' WHEN abs(wow_pct) >= 8 OR coalesce(abs(z) >= 2, FALSE) THEN 'medium' ELSE 'low' END AS severity FROM week",
    "dismissal_reasons": f"{_WEEK} SELECT metric_id, cut, CASE WHEN flags LIKE '%no_exposure%' THEN 'data-quality' WHEN abs(wow_pct) < 8 THEN 'within-baseline-variation' ELSE 'small-absolute-impact' END AS reason FROM week",
    "shortlist": f"{_SHORTLIST} SELECT rank, metric_id, cut, channels FROM listed",
    "facts_long": f"""{_FACTS} SELECT metric_id, k AS statistic_key, kind AS period_type, unit, count(*) AS n, count(v) AS n_value, count(DISTINCT id) AS n_ids,
 round(CAST(sum(CAST(round(v, 4) AS DECIMAL(30,4))) AS DOUBLE), 6) + 0.0 AS total FROM facts JOIN periods USING (label) GROUP BY ALL""",
    "all_facts": f"{_FACTS} SELECT id, unit, CAST(decimals AS INT) AS display_precision, {_six('v', 'value')}, display, flags FROM facts",
    "flagship": f"""{_EVENTS.facts}, gaps AS (SELECT count(*) AS n FROM {_days_of(EVENT_PLAN)} AS t(day) WHERE day NOT IN (SELECT day FROM cells)), newest AS (SELECT max(day) AS newest FROM cells),
 names AS (SELECT * FROM {_values([f"'{k}', '{v}'" for k, v in LABELS.items()])} AS t(k, name)), titles AS (SELECT * FROM {_values([f"'{m.id}', '{m.title}'" for m in REGISTRY.metrics])} AS t(metric_id, title))
SELECT id, metric_id, concat_ws(' | ', title, cut, phrase, name) AS label, k AS statistic_key, cut, cut_dim, cut_value, label AS period_label, kind AS period_type, first_day AS period_start, last_day AS period_end,
       {_six('v', 'value')}, unit, CAST(decimals AS INT) AS display_precision, display
FROM facts JOIN periods USING (label) JOIN names USING (k) JOIN titles USING (metric_id), gaps, newest WHERE n = 0 AND newest >= {_day(EVENT_PLAN.as_of)} - 2""",
    "pack": f"{_FACTS}, {_SHOP.listed}, {_SHOP.packed} SELECT id, display, unit, flags, rank, pos FROM packed",
    "provenance_closure": f"""{_FACTS.replace('WITH', 'WITH RECURSIVE', 1)}, edges AS (SELECT id, unnest(inputs) AS input FROM facts), reached(root, id, depth) AS (
  SELECT id, id, 0 FROM facts WHERE k IN ('contribution_share_pct', 'vs_slice_pct')
  UNION SELECT root, input, depth + 1 FROM reached JOIN edges USING (id) WHERE depth < 2 AND NOT starts_with(input, 'source_rows:')
)
SELECT root, count(*) AS n, CAST(max(depth) AS BIGINT) AS deepest FROM (SELECT root, id, min(depth) AS depth FROM reached GROUP BY ALL) GROUP BY root""",
    "unresolved_inputs": f"{_FACTS}, edges AS (SELECT id, unnest(inputs) AS input FROM facts) SELECT input, id FROM edges WHERE NOT starts_with(input, 'source_rows:') AND input NOT IN (SELECT id FROM facts)",
    "prose_numbers": rf"""WITH apart AS (SELECT doc_id, replace(regexp_replace(text, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', ' ', 'g'), '%', '% ') AS t FROM documents),
 found AS (SELECT doc_id, unnest(regexp_extract_all(t, '{_RE2_FIGURE}', 1)) AS raw FROM apart)
SELECT doc_id, raw, {_RE2_DIGITS} AS digits, {_RE2_KIND} AS kind FROM found""",
    **_BINDING,
    "coverage_days_missing": f"SELECT day FROM {_days_of(LONG_PLAN)} AS t(day) WHERE day NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)",
    "weekly_history": f"""WITH {_CELLS}, weeks AS (SELECT day - CAST(dayofweek(day) AS INT) AS week, sum(sessions) AS sessions, sum(orders) AS orders FROM cells GROUP BY ALL),
 near AS (SELECT *, lag(sessions) OVER w AS prior, avg(sessions) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS base FROM weeks WINDOW w AS (ORDER BY week))
SELECT week, sessions, orders, sessions - prior AS wow_delta, {_six('(sessions - prior) / nullif(abs(prior), 0) * 100', 'wow_pct')}, {_six('base', 'baseline_mean')} FROM near""",
    "trailing_windows": f"""WITH {_CELLS}, days AS (SELECT day, sum(sessions) AS sessions FROM cells GROUP BY day), joined AS (
  SELECT a.day, a.sessions, count(b.day) AS n, median(b.sessions) AS m, mad(b.sessions) AS mad
  FROM days a LEFT JOIN days b ON b.day BETWEEN a.day - 56 AND a.day - 7 AND (a.day - b.day) % 7 = 0 GROUP BY ALL
), scaled AS (SELECT *, greatest(mad * 1.4826, sqrt(greatest(m, 1))) AS s FROM joined)
SELECT day, sessions, n, {_six('m', 'weekday_median')}, CASE WHEN n > 0 AND NOT (m = 0 AND mad = 0) THEN round(s, 6) + 0.0 END AS robust_scale,
       CASE WHEN n > 0 AND NOT (m = 0 AND mad = 0) THEN round((sessions - m) / s, 6) + 0.0 END AS robust_score FROM scaled""",
    "prose_dates": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS date FROM events",
    "prose_lexicons": f"SELECT doc_id, regexp_matches(coalesce(text, ''), '(?i)\\b({CAUSAL})\\b') AS causal, regexp_matches(coalesce(text, ''), '(?i)\\b({MAGNITUDE})\\b') AS magnitude FROM documents",
}


_BASELINE = """count(value) OVER w AS n, avg(value) OVER w AS mean,
  CASE WHEN count(value) OVER w > 1 THEN CASE WHEN max(value) OVER w = min(value) OVER w THEN 0 ELSE stddev_samp(value) OVER w END END AS sd"""
_SUMS = ", ".join(f"CAST(sum({m}) AS DOUBLE) AS {m}" for m in ("sessions", "orders", "gmv"))
_RECORDS = lambda table: " UNION ALL ".join(_metric(i, m).replace("FROM grid", f"FROM {table}") for i, m in enumerate(REGISTRY.metrics))

_GRID = f"""WITH {_CELLS}, sums AS (
  SELECT day, region, priority, grouping(region) AS g1, grouping(priority) AS g2, sum(CAST(sessions AS DECIMAL(30,6))) AS sessions, sum(CAST(orders AS DECIMAL(30,6))) AS orders, sum(CAST(gmv AS DECIMAL(30,6))) AS gmv
  FROM cells WHERE day BETWEEN {_day(HISTORY.reach[0])} AND {_day(HISTORY.reach[1])} GROUP BY GROUPING SETS ((day), (day, region), (day, priority))
), seg AS (
  SELECT day, CASE WHEN g1 = 0 THEN 'region' WHEN g2 = 0 THEN 'priority' END AS cut_dim, CASE WHEN g1 = 0 THEN region WHEN g2 = 0 THEN priority END AS cut_value,
         CASE WHEN g1 = 0 THEN 'region=' || region WHEN g2 = 0 THEN 'priority=' || priority ELSE 'overall' END AS cut, sessions, orders, gmv FROM sums
), dense AS (
  SELECT u.cut, u.cut_dim, u.cut_value, d.day, d.day - CAST(dayofweek(d.day) AS INT) AS week, s.cut IS NULL AS filled, coalesce(s.sessions, 0) AS sessions, coalesce(s.orders, 0) AS orders, coalesce(s.gmv, 0) AS gmv
  FROM (SELECT DISTINCT cut, cut_dim, cut_value FROM seg) u
  CROSS JOIN (SELECT CAST(unnest(generate_series({_day(HISTORY.reach[0])}, {_day(HISTORY.reach[1])}, INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN seg s ON s.cut = u.cut AND s.day = d.day
), seen AS (
  SELECT *, max(CASE WHEN NOT filled THEN day END) OVER (PARTITION BY cut ORDER BY day) AS last_seen FROM dense
), planned AS (
  SELECT cut, week FROM seen GROUP BY ALL HAVING max(last_seen) >= week - {HISTORY.back} AND week + 7 BETWEEN {_day(HISTORY.first)} AND {_day(HISTORY.last)}
)"""

_HISTORY_WEEKS = f"""{_GRID}, week_grid AS (
  SELECT cut, cut_dim, cut_value, week AS label, bool_and(filled) AS filled, {_SUMS} FROM dense GROUP BY ALL
), rec AS ({_RECORDS("week_grid")}), based AS (
  SELECT *, lag(value) OVER s AS prior, lag(numerator) OVER s AS prior_num, lag(denominator) OVER s AS prior_den, bool_and(filled) OVER w AS all_filled, {_BASELINE} FROM rec
  WINDOW s AS (PARTITION BY metric_id, cut ORDER BY label), w AS (PARTITION BY metric_id, cut ORDER BY label ROWS BETWEEN {HISTORY.weeks_back} PRECEDING AND 1 PRECEDING)
), week AS (
  SELECT b.*, label + 7 AS as_of, value - prior AS wow_delta, (value - prior) / nullif(abs(prior), 0) * 100 AS wow_pct, (value - mean) / nullif(abs(mean), 0) * 100 AS pct, (value - mean) / nullif(sd, 0) AS z,
         {_BASE_FLAGS.format(value="value")} AS base_flags, (numerator + prior_num) / nullif(denominator + prior_den, 0) AS pooled,
         CASE WHEN statistic = 'rate' THEN CASE WHEN denominator <= 0 THEN 'no_exposure' ELSE concat_ws(',', CASE WHEN denominator < 30 THEN 'small_denominator' END,
              CASE WHEN least(numerator, denominator - numerator) < 5 THEN 'small_cell' END) END ELSE '' END AS adequacy
  FROM based b JOIN planned p ON p.cut = b.cut AND p.week = b.label
), weeks AS (
  SELECT w.*, CASE WHEN w.cut_dim IS NOT NULL AND w.statistic IN ('count', 'sum') THEN w.wow_delta / nullif(o.wow_delta, 0) * 100 END AS share,
         CASE WHEN w.statistic = 'rate' AND w.denominator > 0 AND w.prior_den > 0 AND w.pooled > 0 AND w.pooled < 1
              THEN (w.numerator / w.denominator - w.prior_num / w.prior_den) / sqrt(w.pooled * (1 - w.pooled) * (1 / w.denominator + 1 / w.prior_den)) END AS rate_z
  FROM week w LEFT JOIN week o ON o.metric_id = w.metric_id AND o.label = w.label AND o.cut = 'overall'
)"""
_SCALED = _SHOP.days[_SHOP.days.index("scaled AS (") :]
_HISTORY_DAYS = f"""day_grid AS (
  SELECT cut, cut_dim, cut_value, day AS label, filled, {_SUMS.replace("sum(", "(")} FROM dense
), day_rec AS ({_RECORDS("day_grid")}), day_base AS (
  SELECT *, count(value) OVER w AS n, median(value) OVER w AS m, mad(value) OVER w AS mad FROM day_rec
  WINDOW w AS (PARTITION BY metric_id, cut, dayofweek(label) ORDER BY label ROWS BETWEEN {HISTORY.days_back} PRECEDING AND 1 PRECEDING)
), sized_days AS (
  SELECT d.*, week + 7 AS as_of, m = 0 AND mad = 0 AS zero, mad * 1.4826 AS wide, CASE WHEN metric_type = 'count' THEN sqrt(greatest(m, 1)) ELSE abs(m) * 0.01 END AS floor
  FROM day_base d JOIN planned p ON p.cut = d.cut AND p.week = label - CAST(dayofweek(label) AS INT)
), {_SCALED}"""
_HISTORY_RUNNING = f"""part_grid AS (
  SELECT cut, cut_dim, cut_value, day AS label, bool_and(filled) OVER w AS filled, {", ".join(f"CAST(sum({m}) OVER w AS DOUBLE) AS {m}" for m in ("sessions", "orders", "gmv"))}
  FROM dense WINDOW w AS (PARTITION BY cut, week ORDER BY day)
), part_rec AS ({_RECORDS("part_grid")}), part_base AS (
  SELECT *, {_BASELINE} FROM part_rec WINDOW w AS (PARTITION BY metric_id, cut, dayofweek(label) ORDER BY label ROWS BETWEEN {HISTORY.weeks_back} PRECEDING AND 1 PRECEDING)
), running AS (
  SELECT b.*, label + 1 AS as_of, (value - mean) / nullif(abs(mean), 0) * 100 AS pct, {_BASE_FLAGS.format(value="value")} AS base_flags FROM part_base b JOIN seen s ON s.cut = b.cut AND s.day = b.label
  WHERE dayofweek(label) < 6 AND last_seen >= week - {7 + HISTORY.back} AND label + 1 BETWEEN {_day(HISTORY.first)} AND {_day(HISTORY.last)}
)"""
_DECIMAL, _NUMERAL = characters("decimal"), characters("numeral")
_POINTS = "CASE unit WHEN 'percent' THEN 'pp' ELSE unit END"
_TOLD = " UNION ALL ".join(
    [f"SELECT as_of, '{k}' AS k, {u} AS unit, metric_id || cut || label AS id, {v} AS v FROM weeks WHERE {c}" for k, u, v, c in (
        ("value", "unit", "value", "TRUE"), ("n_obs", "'count'", "n_obs", "TRUE"), ("wow_delta", _POINTS, "wow_delta", "TRUE"), ("wow_pct", "'percent'", "wow_pct", "TRUE"), ("baseline_mean", "unit", "mean", "TRUE"),
        ("vs_baseline_pct", "'percent'", "pct", "TRUE"), ("screening_z", "'score'", "z", "TRUE"), ("numerator", "'count'", "numerator", "statistic IN ('rate', 'mean')"),
        ("denominator", "'count'", "denominator", "statistic IN ('rate', 'mean')"), ("rate_z", "'score'", "rate_z", "statistic = 'rate'"),
        ("contribution_share_pct", "'percent'", "share", "cut_dim IS NOT NULL AND statistic NOT IN ('rate', 'mean')"))]
    + [f"SELECT as_of, '{k}', {u}, metric_id || cut || label || 'd', {v} FROM scaled" for k, u, v in (
        ("value", "unit", "value"), ("weekday_median", "unit", "m"), ("robust_scale", "unit", "scale"), ("robust_score", "'score'", "score"))]
    + [f"SELECT as_of, '{k}', {u}, metric_id || cut || label || 'p', {v} FROM running" for k, u, v in (("value", "unit", "value"), ("slice_baseline_mean", "unit", "mean"), ("vs_slice_pct", "'percent'", "pct"))])

#: The names of published JSON, in order.
_FACT_KEYS = "cut,cut_dim,cut_value,display,display_precision,flags,id,label,metric_id,period_end,period_label,period_start,period_type,provenance,statistic_key,unit,value"
_AUDIT_KEYS = "claim,claimed_value,computed_value,derivation,display,fact_id,fact_label,highlight,highlight_title,metric_id,period,status,tolerance,unit"

#: How statistics are said to be computed; {field} is what is filled in.
_DERIVED = (
    ("n_obs", "aggregate", "'SUM(' || n_obs_field || ') over the period'", ""), ("numerator", "aggregate", "'SUM(' || numerator_field || ')'", ""), ("denominator", "aggregate", "'SUM(' || denominator_field || ')'", ""),
    ("wow_delta", "wow_delta", "'current - prior_week'", ""), ("wow_pct", "wow_pct", "'100 * (current - prior_week) / |prior_week|'", ""), ("baseline_mean", "baseline_mean", "'mean of 4 prior complete weeks'", ""),
    ("vs_baseline_pct", "vs_baseline_pct", "'100 * (current - baseline_mean) / |baseline_mean|'", ""), ("screening_z", "screening_z", "'(current - baseline_mean) / sample sd of the baseline'", "ranks series; no p-value"),
    ("rate_z", "two_proportion_z", "'(p1 - p2) / sqrt(p (1 - p) (1/n1 + 1/n2)), p pooled'", "visitors return, so this only screens"),
    ("contribution_share_pct", "contribution_share_pct", "'100 * segment change / overall change'", "sums only: means don't decompose"), ("weekday_median", "weekday_median", "'median of the prior same weekdays'", ""),
    ("robust_scale", "robust_scale", "'max(1.4826 * MAD, floor); floor = sqrt(max(median, 1)) for counts, 0.01 * |median| else'", "a floor only widens"),
    ("robust_score", "robust_score", "'(value - weekday_median) / robust_scale'", "no score where all of the baseline is zero"), ("slice_baseline_mean", "slice_baseline_mean", "'mean of the same days of prior weeks'", "never against a whole week"),
    ("vs_slice_pct", "vs_slice_pct", "'100 * (current - slice_baseline_mean) / |slice_baseline_mean|'", ""),
)
#: By the kind of period; a complete week has another note if it is the one under review.
_VALUE_NOTE = f"""CASE WHEN label = '{PLAN.week.label}' THEN 'sum of the source rows of the period' WHEN label = '{PLAN.running.label}' THEN 'the running week up to its last complete day'
 WHEN starts_with(label, 'complete_week') THEN 'an earlier week' WHEN starts_with(label, 'daily') THEN '' ELSE 'the same days of an earlier week' END"""
_FORMULA = "CASE statistic WHEN 'rate' THEN '100 * ' ELSE '' END || 'SUM(' || numerator_field || ')' || CASE WHEN denominator_field IS NULL THEN '' ELSE ' / SUM(' || denominator_field || ')' END || ' over the period'"

ORACLE_SQL |= {
    "history_weeks": f"""{_HISTORY_WEEKS} SELECT as_of, metric_id, cut, {_six('value', 'value')}, {_six('wow_delta', 'wow_delta')}, {_six('wow_pct', 'wow_pct')}, {_six('mean', 'baseline_mean')},
 {_six('pct', 'vs_baseline_pct')}, {_six('z', 'screening_z')}, {_six('rate_z', 'rate_z')}, {_six('share', 'contribution_share_pct')}, flags, base_flags, adequacy FROM weeks""",
    "history_days": f"""{_GRID}, {_HISTORY_DAYS} SELECT as_of, metric_id, cut, label AS day, {_six('value', 'value')}, {_six('m', 'weekday_median')}, round(scale, 1) + 0.0 AS robust_scale, {_six('score', 'robust_score')},
 flags, day_flags AS score_flags FROM scaled""",
    "history_running": f"{_GRID}, {_HISTORY_RUNNING} SELECT as_of, metric_id, cut, {_six('value', 'value')}, {_six('mean', 'slice_baseline_mean')}, {_six('pct', 'vs_slice_pct')}, base_flags FROM running",
    "history_facts": f"""{_HISTORY_WEEKS}, {_HISTORY_DAYS}, {_HISTORY_RUNNING}, told AS ({_TOLD})
SELECT as_of, k AS statistic_key, unit, count(*) AS n, count(v) AS n_value, count(DISTINCT id) AS n_ids, round(CAST(sum(CAST(round(v, 8) AS DECIMAL(38,8))) AS DOUBLE) + {HALF}, 2) + 0.0 AS total FROM told GROUP BY ALL""",
    "story_selection": f"""{_HISTORY_WEEKS.replace("WITH", "WITH RECURSIVE", 1)}, {_HISTORY_DAYS}, sized AS (
  SELECT w.*, round(coalesce(abs(z), 0), 6) AS az, round(coalesce(abs(CASE WHEN statistic IN ('rate', 'mean') THEN wow_pct ELSE share END), 0), 6) AS impact, filled AS gone,
         NOT filled AND all_filled AS fresh FROM weeks w
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY as_of, metric_id, cut_dim ORDER BY az DESC, cut) AS zp, row_number() OVER (PARTITION BY as_of, metric_id, cut_dim ORDER BY impact DESC, cut) AS ip FROM sized WHERE cut_dim IS NOT NULL
), chosen AS (
  SELECT *, concat_ws(',', CASE WHEN ip <= 2 AND impact > 0 AND statistic IN ('count', 'sum') THEN 'contribution_share_pct' END, CASE WHEN gone THEN 'disappeared' END,
            CASE WHEN fresh AND NOT gone THEN 'newly_appeared' END, CASE WHEN zp <= 2 AND az > 0 THEN 'screening_z' END,
            CASE WHEN ip <= 2 AND impact > 0 AND statistic IN ('rate', 'mean') THEN 'wow_pct' END) AS channels FROM placed
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY as_of, metric_id, cut_dim ORDER BY length(channels) - length(replace(channels, ',', '')) DESC, az DESC, cut) AS place FROM chosen WHERE channels <> ''
), in_order AS (
  SELECT as_of, metric_ord, 0 AS dim_ord, 0 AS place, metric_id, cut, 'overall' AS channels, value, wow_pct, z, flags FROM sized WHERE cut = 'overall'
  UNION ALL SELECT as_of, metric_ord, CASE cut_dim WHEN 'region' THEN 1 ELSE 2 END, place, metric_id, cut, channels, value, wow_pct, z, flags FROM kept WHERE place <= 4
), extreme AS (
  SELECT as_of, metric_id, cut, max({{'s': round(abs(score), 6), 'd': label}})['d'] AS day, max(round(abs(score), 6)) AS size FROM scaled WHERE abs(score) >= 6 GROUP BY ALL
), listed AS (
  SELECT o.*, e.day AS news_day, e.size, CAST(row_number() OVER (PARTITION BY as_of ORDER BY metric_ord, dim_ord, place) AS INT) AS rank FROM in_order o LEFT JOIN extreme e USING (as_of, metric_id, cut)
), told_as AS (
  SELECT *, CASE WHEN channels LIKE '%disappeared%' AND value IS NOT NULL THEN 'disappeared' WHEN channels LIKE '%newly_appeared%' AND value IS NOT NULL THEN 'newly_appeared' WHEN size IS NOT NULL THEN 'daily'
                 WHEN abs(wow_pct) >= 3 AND (coalesce(abs(z), 0) >= 2.5 OR abs(wow_pct) >= 8) THEN 'weekly' END AS kind FROM listed
), weighed AS (
  SELECT *, CASE kind WHEN 'daily' THEN news_day END AS day, CASE kind WHEN 'disappeared' THEN 1000 WHEN 'newly_appeared' THEN 900 WHEN 'daily' THEN size ELSE round(20 + greatest(coalesce(abs(z), 0), abs(wow_pct) / 2), 6) END AS weight,
         CASE WHEN kind IN ('disappeared', 'daily') THEN 'high' WHEN kind = 'newly_appeared' THEN 'medium' WHEN kind = 'weekly' THEN
           CASE WHEN abs(wow_pct) >= 20 OR coalesce(abs(z) >= 3, FALSE) THEN 'high' WHEN abs(wow_pct) >= 8 OR coalesce(abs(z) >= 2, FALSE) THEN 'medium' ELSE 'low' END END AS severity,
         CASE WHEN flags LIKE '%no_exposure%' THEN 'data-quality' WHEN abs(wow_pct) < 8 THEN 'within-baseline-variation' ELSE 'small-absolute-impact' END AS reason FROM told_as
), queue AS (
  SELECT *, row_number() OVER (PARTITION BY as_of ORDER BY weight DESC, rank) AS turn FROM weighed WHERE kind IS NOT NULL
), walk(as_of, turn, metrics, cuts, dates, n, outcome, place) AS (
  SELECT DISTINCT as_of, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), CAST([] AS DATE[]), 0, '', 0 FROM queue
  UNION ALL
  SELECT as_of, turn, CASE WHEN ok = 'told' THEN list_append(metrics, metric_id) ELSE metrics END, CASE WHEN ok = 'told' THEN list_append(cuts, cut) ELSE cuts END,
         CASE WHEN ok = 'told' AND day IS NOT NULL THEN list_append(dates, day) ELSE dates END, n + CASE WHEN ok = 'told' THEN 1 ELSE 0 END, ok, n
  FROM (SELECT w.as_of, q.turn, metrics, cuts, dates, n, q.metric_id, q.cut, q.day,
               CASE WHEN len(list_filter(metrics, lambda m: m = q.metric_id)) >= 3 OR list_contains(cuts, q.cut) OR coalesce(list_contains(dates, q.day), FALSE) THEN 'duplicate-of-highlight' WHEN n >= 6 THEN 'small-absolute-impact' ELSE 'told' END AS ok
        FROM walk w JOIN queue q ON q.as_of = w.as_of AND q.turn = w.turn + 1)
)
SELECT w.as_of, w.rank, w.metric_id, w.cut, w.channels, w.kind, w.severity, w.day, coalesce(k.outcome, w.reason) AS outcome, CASE WHEN k.outcome = 'told' THEN CAST(k.place AS INT) END AS place
FROM weighed w LEFT JOIN queue q USING (as_of, rank) LEFT JOIN walk k ON k.as_of = w.as_of AND k.turn = q.turn""",
    "draft_attempts": f"""{_planted()}, ranks AS (SELECT metric_id || '/' || cut AS draft_id, rank % 3 AS turn FROM listed),
 shown(attempt, turn, most) AS (VALUES (0, 0, 99), (0, 1, 99), (0, 2, 99), (1, 0, 0), (1, 1, 2), (1, 2, 2), (2, 0, 2), (2, 1, 0), (2, 2, 2)),
 tried AS (
  SELECT r.draft_id, s.attempt, count(b.code) AS n_violations, coalesce(string_agg(DISTINCT b.code, ',' ORDER BY b.code), '') AS codes
  FROM (SELECT DISTINCT draft_id FROM broken) d JOIN ranks r USING (draft_id) JOIN shown s USING (turn) LEFT JOIN broken b ON b.draft_id = r.draft_id AND (s.most = 99 OR b.h <= s.most) GROUP BY ALL
 )
SELECT draft_id, CAST(attempt AS INT) AS attempt, n_violations, codes, CASE WHEN n_violations = 0 THEN 'passed' WHEN attempt < 2 THEN 'open' ELSE 'refused' END AS state
FROM tried t WHERE NOT EXISTS (SELECT 1 FROM tried e WHERE e.draft_id = t.draft_id AND e.attempt < t.attempt AND e.n_violations = 0)""",
    "stray_numerals": rf"""WITH added AS (
  SELECT doc_id, coalesce(text, '') || CASE doc_id % {len(STRAYS)} {" ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(STRAYS))} END AS t FROM documents
), apart AS (
  SELECT doc_id, replace(regexp_replace(t, '[{_DECIMAL}]{{4}}-[{_DECIMAL}]{{2}}-[{_DECIMAL}]{{2}}', chr(10), 'g'), '%', '% ') AS t FROM added
), without AS (
  SELECT doc_id, regexp_replace(t, '(^|[^\p{{L}}_.,{_NUMERAL}])[-+−]?\$?(?:[{_DECIMAL}]{{1,3}}(?:,[{_DECIMAL}]{{3}})+|[{_DECIMAL}]+)(?:\.[{_DECIMAL}]+)?(?:%|pp)?', '\1', 'g') AS t FROM apart
)
SELECT doc_id, regexp_replace(t, '[^{_NUMERAL}]+', '', 'g') AS strays FROM without""",
    "late_cells": f"WITH {_EVENT_CELLS} SELECT day, bucket, part, sessions, orders, {_six('gmv', 'gmv')} FROM cells",
    "late_weeks": f"""WITH {_EVENT_CELLS} SELECT day - CAST(dayofweek(day) AS INT) AS week, bucket, sum(sessions) AS sessions, sum(orders) AS orders,
 round(CAST(sum(CAST(gmv AS DECIMAL(28,2))) AS DOUBLE), 6) + 0.0 AS gmv FROM cells GROUP BY ALL""",
    "draft_shapes": f"""WITH texts AS (
  SELECT c_custkey AS id, replace(replace(CASE c_custkey % {len(SHAPES)} {" ".join(f"WHEN {i} THEN {_text(t)}" for i, t in enumerate(SHAPES))} END, '{{n}}', c_name), '{{k}}', CAST(c_custkey AS VARCHAR)) AS t FROM customer
), parsed AS (SELECT id, CASE WHEN json_valid(t) THEN CAST(t AS JSON) END AS j FROM texts
), fine AS (
  SELECT id, j FROM parsed WHERE j IS NOT NULL AND json_type(j) = 'OBJECT' AND coalesce(json_type(j, '$.highlights'), 'ARRAY') = 'ARRAY' AND coalesce(json_type(j, '$.dismissals'), 'ARRAY') = 'ARRAY'
), heads AS (
  SELECT id, h, json_extract(j, '$.highlights[' || h || ']') AS x FROM (SELECT id, j, unnest(range(CAST(coalesce(json_array_length(j, '$.highlights'), 0) AS BIGINT))) AS h FROM fine)
), shaped AS (
  SELECT *, json_type(x) = 'OBJECT' AND len(list_intersect(CASE WHEN json_type(x) = 'OBJECT' THEN json_keys(x) ELSE [] END, [{", ".join(map(_text, REQUIRED))}])) = {len(REQUIRED)} AS whole FROM heads
), claims AS (
  SELECT id, h, k, json_extract(x, '$.claims[' || k || ']') AS c FROM (SELECT id, h, x, unnest(range(CAST(json_array_length(x, '$.claims') AS BIGINT))) AS k FROM shaped WHERE whole AND json_type(x, '$.claims') = 'ARRAY')
), passed_over AS (
  SELECT id, json_extract(j, '$.dismissals[' || i || ']') AS d FROM (SELECT id, j, unnest(range(CAST(coalesce(json_array_length(j, '$.dismissals'), 0) AS BIGINT))) AS i FROM fine)
), found(id, h, code, k) AS (
  SELECT id, NULL, 'E001', NULL FROM parsed WHERE id NOT IN (SELECT id FROM fine)
  UNION ALL SELECT id, h, 'E001', NULL FROM shaped WHERE NOT whole
  UNION ALL SELECT id, h, 'E001', NULL FROM shaped WHERE whole AND json_type(x, '$.claims') <> 'ARRAY'
  UNION ALL SELECT id, h, 'E003', NULL FROM shaped WHERE whole AND (json_type(x, '$.severity') <> 'VARCHAR' OR (x ->> '$.severity') NOT IN ({", ".join(map(_text, SEVERITIES))}))
  {" ".join(f"UNION ALL SELECT id, h, 'E001', NULL FROM shaped WHERE whole AND json_type(x, '$.{p}') NOT IN ('VARCHAR', 'NULL')" for p in PROSE)}
  UNION ALL SELECT id, h, 'E001', k FROM claims WHERE json_type(c) <> 'OBJECT' OR json_type(c, '$.fact_id') IS NULL OR json_type(c, '$.value') IS NULL
  UNION ALL SELECT id, NULL, 'E001', NULL FROM passed_over WHERE json_type(d) <> 'OBJECT' OR json_type(d, '$.reason_code') IS NULL
  UNION ALL SELECT id, NULL, 'E050', NULL FROM passed_over WHERE json_type(d, '$.reason_code') IS NOT NULL AND (d ->> '$.reason_code') NOT IN ({", ".join(map(_text, REASONS))})
)
SELECT CAST(id AS VARCHAR) AS draft_id, CAST(h AS INT) AS highlight, code, CAST(k AS INT) AS claim, count(*) AS n FROM found GROUP BY ALL""",
    "source_digests": f"""WITH lines AS (
  SELECT event_id, event_id // {FILE_ROWS} AS file, concat_ws(',', event_id, user_id, event_type, props, CASE WHEN event_id % 50 = 7 THEN 'é' || repeat('三', 300) END, CASE WHEN event_id % 3 = 0 THEN chr(13) END) || chr(10) AS line FROM events
), placed AS (SELECT *, sum(strlen(line)) OVER (PARTITION BY file ORDER BY event_id) - strlen(line) AS start FROM lines
), pieces AS (SELECT file, start // {PIECE} AS piece, sha256(string_agg(line, '' ORDER BY event_id)) AS digest FROM placed GROUP BY ALL
), nodes AS (SELECT file, piece // 4096 AS node, sha256(string_agg(digest, '' ORDER BY piece)) AS digest FROM pieces GROUP BY ALL
), trees AS (SELECT file, sha256(string_agg(digest, '' ORDER BY node)) AS tree_sha256 FROM nodes GROUP BY ALL)
SELECT file, CAST(sum(strlen(line)) AS BIGINT) AS n_bytes, sha256(string_agg(line, '' ORDER BY event_id)) AS sha256, any_value(tree_sha256) AS tree_sha256 FROM lines JOIN trees USING (file) GROUP BY file""",
    "facts_json": f"""{_FACTS} SELECT row_number() OVER (ORDER BY id) + 2 AS line, '{_FACT_KEYS}' AS keys, id, metric_id, k AS statistic_key, unit, CAST(decimals AS INT) AS display_precision, display, {_six('v', 'value')}, flags,
 array_to_string(list_sort(list_filter(inputs, lambda i: NOT starts_with(i, 'source_rows:'))), ' ') AS inputs FROM facts""",
    "audit_rows": f"""{_planted().replace('WITH', 'WITH RECURSIVE', 1)}, edges AS (SELECT id, unnest(inputs) AS input FROM facts), reached(root, id, depth) AS (
  SELECT DISTINCT fact_id, fact_id, 0 FROM judged JOIN facts f ON f.id = fact_id
  UNION SELECT root, input, depth + 1 FROM reached JOIN edges USING (id) WHERE depth < 2 AND NOT starts_with(input, 'source_rows:')
), chains AS (SELECT root, string_agg(id, ' ' ORDER BY depth, id) AS chain FROM (SELECT root, id, min(depth) AS depth FROM reached GROUP BY ALL) GROUP BY root)
SELECT j.draft_id, j.h AS highlight, j.claim, '{_AUDIT_KEYS}' AS keys, j.fact_id, CASE code WHEN 'E010' THEN 'dangling' WHEN 'E011' THEN 'not_in_pack' WHEN 'E012' THEN 'mismatch' WHEN 'E013' THEN 'mismatch' WHEN 'E014' THEN 'off_subject' ELSE 'bound' END AS status,
 h.title AS highlight_title, h.metric_id, f.display, f.unit, {_six('claimed', 'claimed')}, {_six('computed', 'computed')}, {_six('0.5 * pow(10, -f.decimals)', 'tolerance')},
 CAST(first_day AS VARCHAR) AS first_day, CAST(last_day AS VARCHAR) AS last_day, coalesce(chain, '') AS derivation
FROM judged j JOIN heads h USING (draft_id, h) LEFT JOIN facts f ON f.id = j.fact_id LEFT JOIN periods p ON p.label = f.label LEFT JOIN chains ON root = j.fact_id""",
    "rendered_rows": rf"""WITH kinds(kind, severity, title, narrative) AS (VALUES {", ".join(f"({i}, {', '.join(map(_text, k))})" for i, k in enumerate(UNTRUSTED))}
), heads AS (
  SELECT c_custkey, h, severity, 'gmv' AS metric_id, 'seg|' || c_mktsegment AS cut, replace(title, '{{n}}', c_name) AS title, replace(narrative, '{{n}}', c_name) AS narrative, '' AS hypothesis
  FROM customer, (VALUES (0), (1), (2)) AS t(h) JOIN kinds ON kind = (c_custkey * (h + 1) + h) % {len(UNTRUSTED)}
), texts AS (
  UNPIVOT (SELECT c_custkey, h, severity AS s, CAST(severity AS VARCHAR) AS severity, metric_id, cut, title, narrative, hypothesis FROM heads) ON severity, metric_id, cut, title, narrative, hypothesis INTO NAME field VALUE t
), clean AS (
  SELECT *, length(t) - length(replace(replace(t, '<', ''), '>', '')) AS taken, regexp_replace(regexp_replace(replace(t, chr(10), ' '), '[\x00-\x08\x0b\x0c\x0e-\x1f<>]', '', 'g'), '^\s+|\s+$', '', 'g') AS c FROM texts
), judged AS (SELECT *, regexp_matches(c, '^([-*+>|]|#{{1,6}}|[0-9]+\.) ') AS opens FROM clean
), shown AS (SELECT c_custkey, h, s, field, taken + CAST(opens AS INT) AS n, CASE WHEN opens THEN '\' ELSE '' END || c AS p FROM judged)
SELECT CAST(c_custkey AS VARCHAR) AS draft_id, h AS highlight, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY CASE s WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE 3 END, h) AS INT) AS place,
 {", ".join(f"max(CASE WHEN field = '{c}' THEN replace(p, '|', chr(92) || '|') END) AS {c}" for c in ("severity", "metric_id", "cut", "title"))},
 {", ".join(f"max(CASE WHEN field = '{c}' THEN p END) AS {c}" for c in ("narrative", "hypothesis"))}, CAST(sum(n) AS INT) AS redactions
FROM shown GROUP BY c_custkey, h, s""",
    "cells_csv": f"""WITH {_CELLS} SELECT 1 AS line, 'date,region,priority,sessions,orders,gmv' AS value
UNION ALL SELECT row_number() OVER (ORDER BY day, region, priority) + 1, concat_ws(',', strftime(day, '%Y-%m-%d'), region, priority, CAST(sessions AS BIGINT), CAST(orders AS BIGINT), CAST(gmv AS DECIMAL(18,2))) FROM cells""",
    "fact_provenance": f"""{_FACTS}, fields(metric_id, statistic, n_obs_field, numerator_field, denominator_field) AS (
  VALUES ('gmv', 'sum', 'orders', 'gmv', NULL), ('orders', 'count', 'orders', 'orders', NULL), ('sessions', 'count', 'sessions', 'sessions', NULL), ('conversion_rate', 'rate', 'sessions', 'orders', 'sessions'), ('aov', 'mean', 'orders', 'gmv', 'orders')
) SELECT id, CASE k {" ".join(f"WHEN '{k}' THEN '{c}'" for k, c, _, _ in _DERIVED)} ELSE 'aggregate' END AS computation, CASE k {" ".join(f"WHEN '{k}' THEN {f}" for k, _, f, _ in _DERIVED)} ELSE {_FORMULA} END AS formula,
 CASE k {" ".join(f"WHEN '{k}' THEN {_text(n)}" for k, _, _, n in _DERIVED)} ELSE {_VALUE_NOTE} END AS note FROM facts JOIN fields USING (metric_id)""",
}
