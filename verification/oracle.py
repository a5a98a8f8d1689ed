"""DuckDB statements that give the expected result of the queries.

They are written on flat rows, without the nested records the engine works on, so both sides reach
a result on different ways.
"""

_BASE = """
book AS (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS play_id, c_mktsegment AS character_chosen,
    o_orderkey % 21 AS ascension_level, o_totalprice > 250000 AS victory,
    o_orderkey % 61 AS floor_reached, o_orderkey % 50 = 0 AS is_endless,
    o_orderkey % 50 = 1 AS is_daily, o_orderkey % 50 = 2 AS chose_seed,
    CASE WHEN o_orderkey % 50 <> 4 THEN o_orderkey % 50 = 3 END AS is_trial,
    o_custkey AS player_experience, CAST(floor(o_totalprice) AS BIGINT) AS score,
    o_orderkey * 31 % 7200 AS playtime, o_custkey % 400 AS gold,
    o_custkey % 7 AS campfire_rested, o_orderkey % 5 AS campfire_upgraded,
    o_orderpriority AS neow_bonus, o_orderstatus AS neow_cost,
    CASE WHEN NOT (o_totalprice > 250000) THEN o_orderpriority END AS killed_by,
    greatest(o_orderkey % 61 - o_custkey % 4 * 5, 1) AS hp_length
  FROM orders JOIN customer ON o_custkey = c_custkey
),
lines AS (
  SELECT l_orderkey AS k,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      l_extendedprice, l_quantity, l_shipdate) - 1 AS INTEGER) AS pick_num,
    CASE WHEN (l_partkey + l_suppkey) % 101 <> 0 THEN l_linenumber * 4 END AS floor,
    CASE WHEN l_returnflag = 'N' THEN 'SKIP'
      ELSE p_brand || CASE WHEN l_linestatus = 'O' THEN '+1' ELSE '' END END AS picked,
    'Brand#' || (l_partkey % 25 + 1) AS first_passed,
    'Brand#' || (l_suppkey % 25 + 1) AS second_passed,
    l_linenumber * 5 AS relic_floor, p_brand AS relic,
    substr('ME?T$R', CAST(floor(l_quantity) AS BIGINT) % 6 + 1, 1) AS code,
    l_linestatus = 'O' AS is_relic, l_tax > 0.04 AS is_potion
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
per_run AS (
  SELECT k, max(floor) AS last_choice, count(*) AS n_lines, count(floor) AS n_choices,
    list(relic_floor) AS relic_floors,
    CAST(count(*) FILTER (code = 'E') AS INTEGER) AS num_elites_fought,
    CAST(count(*) FILTER (code = '?') AS INTEGER) AS num_events,
    CAST(count(*) FILTER (code = 'T') AS INTEGER) AS num_treasures,
    CAST(count(*) FILTER (code = '$') AS INTEGER) AS num_shops,
    CAST(count(*) FILTER (is_relic) AS INTEGER) AS relics,
    CAST(count(*) FILTER (is_potion) AS INTEGER) AS num_potions_obtained
  FROM lines GROUP BY k
),
standard AS (
  SELECT * FROM book JOIN per_run USING (k)
  WHERE NOT is_endless AND NOT is_daily AND NOT is_trial AND NOT chose_seed
    AND floor_reached >= 5 AND NOT (floor_reached > 57 OR last_choice > floor_reached)
),
events AS (
  SELECT *, floor - floor_reached + hp_length - 1 AS spot
  FROM standard JOIN lines USING (k) WHERE floor IS NOT NULL
),
picks AS (
  SELECT k, play_id, pick_num, CASE WHEN picked <> 'SKIP' THEN picked END AS card,
    picked <> 'SKIP' AS is_selected, floor AS choice_floor, first_passed, second_passed,
    floor_reached, victory, character_chosen, ascension_level,
    CASE WHEN spot >= 0 AND spot < hp_length THEN (k * 7 + (spot + 1) * 13) % 80 END AS current_hp,
    CASE WHEN spot >= 0 AND spot < hp_length THEN
      CAST(CASE WHEN k % 97 = 0 THEN 0 ELSE 80 END AS BIGINT) END AS max_hp,
    CAST(len(list_filter(relic_floors, lambda f: f <= floor)) AS INTEGER) AS relic_count,
    neow_bonus, neow_cost, player_experience, floor_reached - floor AS floors_gained
  FROM events
),
offers AS (
  SELECT play_id, pick_num, option.card_name, option.was_picked, NOT is_selected AS was_skip,
    choice_floor AS floor, floor_reached, victory, character_chosen, ascension_level, current_hp,
    max_hp, relic_count, neow_bonus, neow_cost, player_experience, floors_gained
  FROM (
    SELECT *, unnest(
      CASE WHEN is_selected THEN [{'card_name': card, 'was_picked': true}] ELSE [] END
      || [{'card_name': first_passed, 'was_picked': false},
          {'card_name': second_passed, 'was_picked': false}]) AS option
    FROM picks)
),
lift AS (
  SELECT *, win_rate_picked - win_rate_not_picked AS win_rate_lift,
    floors_gained_picked - floors_gained_not_picked AS floors_gained_lift
  FROM (
    SELECT character_chosen, card_name, count(*) AS n_offered,
      CAST(sum(CAST(was_picked AS INTEGER)) AS BIGINT) AS n_picked,
      avg(CAST(was_picked AS INTEGER)) AS pick_rate,
      avg(CAST(victory AS INTEGER)) FILTER (was_picked) AS win_rate_picked,
      avg(CAST(victory AS INTEGER)) FILTER (NOT was_picked) AS win_rate_not_picked,
      avg(floors_gained) FILTER (was_picked) AS floors_gained_picked,
      avg(floors_gained) FILTER (NOT was_picked) AS floors_gained_not_picked
    FROM offers GROUP BY character_chosen, card_name)
),
screen AS (
  SELECT *, n_offered - n_picked AS n_not_picked FROM lift
  WHERE n_picked >= 20 AND n_offered - n_picked >= 20
),
model AS (
  SELECT character_chosen, card_name, was_picked, victory, floor, relic_count, ascension_level,
    current_hp / max_hp AS hp_ratio
  FROM offers
  WHERE character_chosen IS NOT NULL AND card_name IS NOT NULL AND was_picked IS NOT NULL
    AND victory IS NOT NULL AND floor IS NOT NULL AND current_hp IS NOT NULL
    AND relic_count IS NOT NULL AND ascension_level IS NOT NULL AND max_hp > 0
),
tests AS (
  SELECT c_mktsegment AS character_chosen, 'Card#' || o_orderkey AS card_name,
    o_orderkey AS n, CASE WHEN o_orderpriority = '5-LOW' THEN 'too few rows' END AS error,
    o_orderstatus <> 'P' AS converged, o_totalprice > 100000 AS native_pool,
    uniform * uniform * uniform AS was_picked_pvalue, 0.5 + (o_orderkey % 1000) / 1000 AS odds_ratio
  FROM (SELECT *, ((o_orderkey * 7919) % 10007 + 1) / 10008 AS uniform FROM orders)
    JOIN customer ON o_custkey = c_custkey
),
steps AS (
  SELECT *, CASE WHEN tested THEN
      least(min(raw) OVER (PARTITION BY tested ORDER BY was_picked_pvalue DESC), 1.0)
    END AS was_picked_qvalue
  FROM (
    SELECT *, was_picked_pvalue * count(*) OVER (PARTITION BY tested)
      / count(*) OVER (PARTITION BY tested ORDER BY was_picked_pvalue) AS raw
    FROM (SELECT *, error IS NULL AND coalesce(converged, false) AS tested FROM tests))
),
effects AS (
  SELECT * FROM steps
  WHERE tested AND native_pool AND was_picked_qvalue < 0.05
    AND (odds_ratio <= 0.9 OR odds_ratio >= 1.1)
)
"""


def _sql(statement: str, more: str = "") -> str:
    return f"WITH {_BASE}{',' + more if more else ''}\n{statement.strip()}"


_RUN_FIELDS = """play_id, character_chosen, ascension_level, victory, floor_reached,
  score, playtime, gold, killed_by"""

_OFFER_FIELDS = """play_id, pick_num, card_name, was_picked, was_skip, floor, floor_reached, victory,
  character_chosen, ascension_level, current_hp, max_hp, relic_count, neow_bonus, neow_cost,
  player_experience, floors_gained"""

_OFFERS = f"SELECT {_OFFER_FIELDS} FROM offers"

_SUMMARY = """
SELECT play_id, victory, floor_reached, character_chosen, ascension_level, score, playtime, gold,
  neow_bonus, neow_cost, player_experience, killed_by, relics AS relic_count, num_elites_fought,
  num_events, num_treasures, num_shops, campfire_rested, campfire_upgraded, num_potions_obtained,
  pick_count, cards_picked, skip_count
FROM standard JOIN (
  SELECT play_id, count(*) AS pick_count, count(*) FILTER (is_selected) AS cards_picked,
    count(*) FILTER (NOT is_selected) AS skip_count
  FROM picks GROUP BY play_id) USING (play_id)
"""

_TIER_CTES = """
bosses AS (
  SELECT *, CAST(unnest(range(0, least(player_experience % 5, 3))) AS INTEGER) AS tier
  FROM standard WHERE n_choices > 0
),
boss_events AS (
  SELECT *, CASE WHEN (k + tier) % 4 <> 0 THEN 'Relic#' || ((k + tier * 7) % 30) END AS picked
  FROM bosses
),
tier_offers AS (
  SELECT *, picked AS relic_name, true AS was_picked FROM boss_events WHERE picked IS NOT NULL
  UNION ALL
  SELECT *, 'Relic#' || ((k + tier * 11 + 1) % 30), false FROM boss_events
  UNION ALL
  SELECT *, 'Relic#' || ((k + tier * 13 + 2) % 30), false FROM boss_events
)
"""

_TIERS = """
SELECT play_id, tier AS boss_relic_tier, relic_name, was_picked, picked IS NULL AS was_skip,
  relics AS relic_count, floor_reached, victory, character_chosen, ascension_level, neow_bonus,
  neow_cost, player_experience
FROM tier_offers
"""

_LIFT_FIELDS = """character_chosen, card_name, n_offered, n_picked, pick_rate, win_rate_picked,
  win_rate_not_picked, floors_gained_picked, floors_gained_not_picked, win_rate_lift,
  floors_gained_lift"""


def _top_lift(metric: str) -> str:
    return f"""
SELECT '{metric}' AS metric, CAST(position AS INTEGER) AS position, character_chosen, card_name,
  n_offered, pick_rate, win_rate_lift, floors_gained_lift
FROM (SELECT *, row_number() OVER (
        PARTITION BY character_chosen ORDER BY {metric} DESC, card_name) AS position FROM screen)
WHERE position <= 15
"""


def _side(side: str, direction: str) -> str:
    return f"""
SELECT '{side}' AS side, CAST(position AS INTEGER) AS position, character_chosen, card_name, n,
  odds_ratio, was_picked_pvalue
FROM (SELECT *, row_number() OVER (PARTITION BY character_chosen
        ORDER BY odds_ratio {direction}, card_name) AS position FROM effects)
WHERE position <= 5
"""


# ---- logistic regression -----------------------------------------------------------------------

_PAIR = "character_chosen, card_name"
_ASCENSION = "character_chosen, ascension_level"


def _groups(keys: str, source: str = "model") -> str:
    return f"""
groups AS (
  SELECT {keys}, count(*) AS n, count(*) FILTER (victory) AS wins,
    CASE WHEN count(*) < 200 THEN 'too few rows'
      WHEN count(*) FILTER (victory) IN (0, count(*)) THEN 'one outcome class'
      WHEN count(*) FILTER (was_picked) IN (0, count(*)) THEN 'Singular matrix' END AS error
  FROM {source} GROUP BY {keys}
)
"""


def _p_value(x: str) -> str:
    """The complementary error function, from its all-positive series."""
    return f"""abs(1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(0, 160), lambda t:
      {x} * coalesce(list_product(list_transform(range(1, t + 1), lambda v: 2 * {x} * {x} / (2 * v + 1))), 1)
    )))"""


def _flag_fits(keys: str, source: str = "model") -> str:
    """With the flag alone the fit has a closed form in the four counts of flag and outcome.

    An empty count means that the outcome is separated: nothing converges.
    """
    half_width = "1.959963984540054 * se"
    return f"""{_groups(keys, source)},
counts AS (
  SELECT *, error IS NULL AND least(a, b, c, d) > 0 AS fine FROM groups JOIN (
    SELECT {keys}, count(*) FILTER (was_picked AND victory) AS a,
      count(*) FILTER (was_picked AND NOT victory) AS b,
      count(*) FILTER (NOT was_picked AND victory) AS c,
      count(*) FILTER (NOT was_picked AND NOT victory) AS d
    FROM {source} GROUP BY {keys}) USING ({keys})
),
flag_fits AS (
  SELECT {keys}, n, error, CASE WHEN error IS NULL THEN fine END AS converged, coef AS was_picked_coef,
    CASE WHEN fine THEN {_p_value("x")} END AS was_picked_pvalue, exp(coef) AS odds_ratio,
    exp(coef - {half_width}) AS odds_ratio_ci_low, exp(coef + {half_width}) AS odds_ratio_ci_high,
    CASE WHEN fine THEN 1 - (a * ln(a / (a + b)) + b * ln(b / (a + b))
        + c * ln(c / (c + d)) + d * ln(d / (c + d)))
      / (wins * ln(wins / n) + (n - wins) * ln(1 - wins / n)) END AS pseudo_r2,
    CASE WHEN fine THEN
      (greatest(a * d, b * c) + (a * b + c * d) / 2) / ((a + c) * (b + d)) END AS auc
  FROM (
    SELECT *, abs(coef) / (se * sqrt(2)) AS x FROM (
      SELECT *, CASE WHEN fine THEN ln(a * d / (b * c)) END AS coef,
        CASE WHEN fine THEN sqrt(1 / a + 1 / b + 1 / c + 1 / d) END AS se
      FROM counts))
)
"""


def _two_by_two(keys: str) -> str:
    numbers = (
        "was_picked_coef", "was_picked_pvalue", "odds_ratio", "odds_ratio_ci_low",
        "odds_ratio_ci_high", "pseudo_r2", "auc",
    )
    rounded = ", ".join(f"round({name}, 6) AS {name}" for name in numbers)
    return f"SELECT {keys}, n, error, converged, {rounded} FROM flag_fits"


_SEPARATED = """
separated AS (
  SELECT character_chosen, card_name, was_picked,
    CASE WHEN card_name LIKE 'Brand#2%' THEN was_picked
      WHEN card_name LIKE 'Brand#1%' THEN was_picked OR victory ELSE victory END AS victory
  FROM model
),"""

_HELPED = """
helped AS (
  SELECT character_chosen, card_name, was_picked,
    victory OR (card_name LIKE 'Brand#2%' AND was_picked AND relic_count % 2 = 0) AS victory
  FROM model
),"""

_HELPED_REPORT = """
SELECT character_chosen, card_name, n, round(odds_ratio, 6) AS odds_ratio,
  round(odds_ratio_ci_low, 6) AS odds_ratio_ci_low,
  round(odds_ratio_ci_high, 6) AS odds_ratio_ci_high,
  round(was_picked_pvalue, 6) AS was_picked_pvalue,
  round(was_picked_qvalue, 6) AS was_picked_qvalue, round(pseudo_r2, 6) AS pseudo_r2,
  round(auc, 6) AS auc
FROM (
  SELECT *, least(min(raw) OVER (PARTITION BY tested ORDER BY was_picked_pvalue DESC), 1.0) AS was_picked_qvalue
  FROM (
    SELECT *, was_picked_pvalue * count(*) OVER (PARTITION BY tested)
        / count(*) OVER (PARTITION BY tested ORDER BY was_picked_pvalue) AS raw,
      sum(n) OVER (PARTITION BY base_card, character_chosen) / sum(n) OVER (PARTITION BY base_card) AS share
    FROM (SELECT *, coalesce(converged, false) AS tested,
            regexp_replace(card_name, '\\+1$', '') AS base_card FROM flag_fits)))
WHERE tested AND share >= 0.2 AND was_picked_qvalue < 0.05 AND (odds_ratio <= 0.9 OR odds_ratio >= 1.1)
ORDER BY character_chosen, odds_ratio DESC"""


def _content(name: str, source: str, columns: str) -> str:
    total = " + ".join(f"coalesce(sum(CAST({c} AS BIGINT)), 0)" for c in columns.split())
    return f"""
SELECT '{name}' AS table_name, character_chosen, count(*) AS row_count, CAST({total} AS BIGINT) AS content,
  CAST(sum(count(*)) OVER () AS BIGINT) AS reported
FROM {source} GROUP BY character_chosen"""


_STORED = " UNION ALL ".join(
    [
        _content(
            "bronze_runs", "book",
            "ascension_level victory floor_reached is_endless is_daily is_trial chose_seed score playtime gold "
            "campfire_rested campfire_upgraded player_experience",
        ),
        _content(
            "silver_picks", "picks",
            "pick_num is_selected choice_floor floor_reached victory ascension_level current_hp max_hp relic_count "
            "player_experience floors_gained",
        ),
        _content(
            "silver_card_offers", "offers",
            "pick_num was_picked was_skip floor floor_reached victory ascension_level current_hp max_hp relic_count "
            "player_experience floors_gained",
        ),
        _content(
            "gold_run_summary", f"({_SUMMARY})",
            "victory floor_reached ascension_level score playtime gold player_experience relic_count num_elites_fought "
            "num_events num_treasures num_shops campfire_rested campfire_upgraded num_potions_obtained pick_count "
            "cards_picked skip_count",
        ),
        _content(
            "gold_relic_offers", f"({_TIERS})",
            "boss_relic_tier was_picked was_skip relic_count floor_reached victory ascension_level player_experience",
        ),
    ]
)

_HEADS = """SELECT character_chosen, card_name FROM (
    SELECT *, row_number() OVER (PARTITION BY character_chosen ORDER BY floors_gained_lift DESC, card_name) AS by_floors,
      row_number() OVER (PARTITION BY character_chosen ORDER BY win_rate_lift DESC, card_name) AS by_wins
    FROM screen) WHERE by_floors = 1 OR by_wins = 1"""

_STORED_PAIRS = f"SELECT * FROM model SEMI JOIN ({_HEADS}) USING (character_chosen, card_name)"

_FLAG_ONLY = """
SELECT character_chosen, card_name, count(*) AS n,
  CASE WHEN count(*) < 200 THEN 'too few rows' END AS error,
  CASE WHEN count(*) >= 200 THEN CASE
    WHEN least(count(*) FILTER (was_picked), count(*) FILTER (NOT was_picked)) < 20 THEN 0.0
    ELSE round(avg(floors_gained) FILTER (was_picked) - avg(floors_gained) FILTER (NOT was_picked), 6) END
  END AS was_picked_effect
FROM offers JOIN (
  SELECT character_chosen, card_name FROM (
    SELECT *, row_number() OVER (PARTITION BY character_chosen ORDER BY floors_gained_lift DESC, card_name) AS by_floors,
      row_number() OVER (PARTITION BY character_chosen ORDER BY win_rate_lift DESC, card_name) AS by_wins
    FROM screen) WHERE by_floors = 1 OR by_wins = 1) USING (character_chosen, card_name)
WHERE floors_gained IS NOT NULL AND floor IS NOT NULL AND current_hp IS NOT NULL AND relic_count IS NOT NULL
  AND ascension_level IS NOT NULL AND max_hp > 0 AND was_picked IS NOT NULL
GROUP BY character_chosen, card_name
"""


def _tree_ctes(trees: int, depth: int) -> str:
    """Boosted trees over all screened pairs, one level of one tree after the other, on single rows."""
    keys, features = "character_chosen, card_name", ("was_picked", "hp_ratio", "floor", "relic_count", "ascension_level")
    ctes = [
        f"""
tree_input AS (
  SELECT row_number() OVER () AS id, {keys}, was_picked::INT::DOUBLE AS was_picked, current_hp / max_hp AS hp_ratio,
    floor::DOUBLE AS floor, relic_count::DOUBLE AS relic_count, ascension_level::DOUBLE AS ascension_level, floors_gained::DOUBLE AS y
  FROM offers SEMI JOIN screen USING ({keys})
  WHERE floors_gained IS NOT NULL AND floor IS NOT NULL AND current_hp IS NOT NULL AND relic_count IS NOT NULL
    AND ascension_level IS NOT NULL AND max_hp > 0 AND was_picked IS NOT NULL
),
tree_sizes AS (SELECT {keys}, count(*) AS n FROM tree_input GROUP BY {keys}),
tree_long AS (
  SELECT id, {keys}, y, pair[1]::INT AS j, pair[2] AS v FROM (
    SELECT *, unnest([{", ".join(f"[{j}.0, {name}]" for j, name in enumerate(features))}]) AS pair
    FROM tree_input SEMI JOIN (SELECT {keys} FROM tree_sizes WHERE n >= 200) USING ({keys}))
),
tree_values AS (SELECT {keys}, j, v, count(*) AS n FROM tree_long GROUP BY ALL),
tree_bins AS (
  SELECT {keys}, j, v, CASE WHEN j = 0 THEN v::INT
    WHEN count(*) OVER (PARTITION BY {keys}, j) <= 255 THEN row_number() OVER (PARTITION BY {keys}, j ORDER BY v) - 1
    ELSE 255 * (sum(n) OVER (PARTITION BY {keys}, j ORDER BY v) - n) // sum(n) OVER (PARTITION BY {keys}, j) END::INT AS bin
  FROM tree_values
),
state_0 AS (
  SELECT id, {keys}, any_value(y) AS y, list(bin ORDER BY j) AS b, 0.0::DOUBLE AS f, 0.0::DOUBLE AS f_on, 0.0::DOUBLE AS f_off, 0 AS splits
  FROM tree_long JOIN tree_bins USING ({keys}, j, v) GROUP BY id, {keys}
)"""
    ]
    for tree in range(trees):
        ctes.append(f"at_{tree}_0 AS (SELECT *, 1 AS node, 1 AS node_on, 1 AS node_off FROM state_{tree})")
        for level in range(depth):
            at, name = f"at_{tree}_{level}", f"{tree}_{level}"
            ctes.append(
                f"""
histogram_{name} AS (
  SELECT {keys}, node, j, b[j + 1] AS bin, count(*) AS n, sum(y - f) AS g
  FROM {at}, range(0, {len(features)}) AS r(j) WHERE node >= {1 << level} GROUP BY ALL
),
sums_{name} AS (
  SELECT {keys}, node, j, bin, sum(n) OVER (w ORDER BY bin) AS nl, sum(g) OVER (w ORDER BY bin) AS gl, sum(n) OVER w AS n, sum(g) OVER w AS g
  FROM histogram_{name} WINDOW w AS (PARTITION BY {keys}, node, j)
),
gains_{name} AS (
  SELECT *, round(gl * gl / nl + (g - gl) * (g - gl) / (n - nl) - g * g / n, 6) AS gain FROM sums_{name} WHERE nl >= 20 AND n - nl >= 20
),
split_{name} AS (
  SELECT {keys}, node, j, bin, gl / nl AS l, (g - gl) / (n - nl) AS r FROM gains_{name} WHERE gain > 0
  QUALIFY row_number() OVER (PARTITION BY {keys}, node ORDER BY gain DESC, j, bin) = 1
),
at_{tree}_{level + 1} AS (
  SELECT a.* REPLACE (
    CASE WHEN s.node IS NULL THEN a.node ELSE 2 * a.node + (a.b[s.j + 1] > s.bin)::INT END AS node,
    CASE WHEN n.node IS NULL THEN a.node_on ELSE 2 * a.node_on + (CASE WHEN n.j = 0 THEN 1 ELSE a.b[n.j + 1] END > n.bin)::INT END AS node_on,
    CASE WHEN o.node IS NULL THEN a.node_off ELSE 2 * a.node_off + (CASE WHEN o.j = 0 THEN 0 ELSE a.b[o.j + 1] END > o.bin)::INT END AS node_off)
  FROM {at} AS a
  LEFT JOIN split_{name} AS s ON s.character_chosen = a.character_chosen AND s.card_name = a.card_name AND s.node = a.node
  LEFT JOIN split_{name} AS n ON n.character_chosen = a.character_chosen AND n.card_name = a.card_name AND n.node = a.node_on
  LEFT JOIN split_{name} AS o ON o.character_chosen = a.character_chosen AND o.card_name = a.card_name AND o.node = a.node_off
)"""
            )
        splits = " UNION ALL ".join(f"SELECT * FROM split_{tree}_{level}" for level in range(depth))
        share = "1.0" if tree == 0 else "0.1"
        ctes.append(
            f"""
all_{tree} AS ({splits}),
value_{tree} AS (
  SELECT {keys}, 1 AS node, sum(g) / sum(n) AS v FROM histogram_{tree}_0 WHERE j = 0 GROUP BY {keys}
  UNION ALL SELECT {keys}, 2 * node, l FROM all_{tree} UNION ALL SELECT {keys}, 2 * node + 1, r FROM all_{tree}
),
flags_{tree} AS (SELECT {keys}, count(*) FILTER (j = 0) AS on_flag FROM all_{tree} GROUP BY {keys}),
state_{tree + 1} AS (
  SELECT id, {keys}, y, b, f + {share} * p.v AS f, f_on + {share} * n.v AS f_on, f_off + {share} * o.v AS f_off,
    splits + coalesce(on_flag, 0) AS splits
  FROM at_{tree}_{depth} AS a LEFT JOIN flags_{tree} USING ({keys})
  JOIN value_{tree} AS p USING ({keys}, node)
  JOIN (SELECT {keys}, node AS node_on, v FROM value_{tree}) AS n USING ({keys}, node_on)
  JOIN (SELECT {keys}, node AS node_off, v FROM value_{tree}) AS o USING ({keys}, node_off)
)"""
        )
    return ",\n".join(ctes)


_SHALLOW_TREES = """
SELECT character_chosen, card_name, n, CASE WHEN n < 200 THEN 'too few rows' END AS error,
  round(effect, 6) AS was_picked_effect, splits AS was_picked_importance
FROM tree_sizes LEFT JOIN (
  SELECT character_chosen, card_name, avg(f_on - f_off) AS effect, max(splits)::BIGINT AS splits FROM state_2
  GROUP BY character_chosen, card_name) USING (character_chosen, card_name)
"""


_X = ["1.0", "flag", "hp_ratio", "floor", "relic_count", "ascension_level"]
_NEWTON_STEPS = 9


def _newton_ctes() -> str:
    """Full fits: Newton steps on group sums, each solved by elimination over the columns.

    The matrix has two right sides, the gradient (g) and the unit vector of the flag (u), so that
    the step and the variance of the flag come from one elimination.
    """
    size = range(len(_X))
    keys = "character_chosen, card_name"
    ctes = [
        f"""
rows_0 AS (
  SELECT {keys}, CAST(was_picked AS INTEGER) AS flag, hp_ratio, floor, relic_count, ascension_level,
    CAST(victory AS INTEGER) AS won
  FROM model JOIN groups USING ({keys}) WHERE error IS NULL
),
beta_0 AS (SELECT DISTINCT {keys}, {', '.join(f'0.0::DOUBLE AS b{i}' for i in size)} FROM rows_0)"""
    ]
    eta = " + ".join(f"b{i} * {x}" for i, x in enumerate(_X))
    for s in range(1, _NEWTON_STEPS + 1):
        gradient = [f"sum((won - p) * {x}) AS g{i}" for i, x in enumerate(_X)]
        matrix = [f"sum(p * (1 - p) * {_X[i]} * {_X[j]}) AS m{i}{j}" for i in size for j in size]
        unit = [f"{1.0 if i == 1 else 0.0}::DOUBLE AS u{i}" for i in size]
        betas = [f"b{i}" for i in size]
        ctes.append(f"""
solve_{s}_0 AS (
  SELECT {keys}, {', '.join(f'any_value({b}) AS {b}' for b in betas)}, {', '.join(gradient)},
    {', '.join(matrix)}, {', '.join(unit)}, sum(won * eta - ln(1 + exp(eta))) AS log_lik
  FROM (SELECT *, 1 / (1 + exp(-eta)) AS p
        FROM (SELECT *, {eta} AS eta FROM rows_0 JOIN beta_{s - 1} USING ({keys})))
  GROUP BY {keys})""")
        for pivot in size:
            columns = []
            for i in size:
                for name in (*[f"m{{}}{j}" for j in size], "g{}", "u{}"):
                    own, lead = name.format(i), name.format(pivot)
                    scaled = f"{lead} / m{pivot}{pivot}"
                    reduced = scaled if i == pivot else f"{own} - m{i}{pivot} * {scaled}"
                    columns.append(f"{reduced} AS {own}")
            ctes.append(
                f"\nsolve_{s}_{pivot + 1} AS (SELECT {keys}, {', '.join(betas)}, log_lik, "
                f"{', '.join(columns)} FROM solve_{s}_{pivot})"
            )
        moved = ", ".join(f"b{i} + g{i} AS b{i}" for i in size)
        ctes.append(
            f"\nbeta_{s} AS (SELECT {keys}, {moved}, u1 AS variance, log_lik "
            f"FROM solve_{s}_{len(_X)})"
        )
    ctes.append(f"""
scores AS (
  SELECT {keys}, {eta} AS eta, won FROM rows_0 JOIN beta_{_NEWTON_STEPS} USING ({keys})
),
aucs AS (
  SELECT {keys}, sum(won * (below + ties / 2)) / (sum(won) * sum(1 - won)) AS auc
  FROM (
    SELECT *, sum(1 - won) OVER (PARTITION BY {keys}, eta) AS ties,
      sum(1 - won) OVER (PARTITION BY {keys} ORDER BY eta)
        - sum(1 - won) OVER (PARTITION BY {keys}, eta) AS below
    FROM scores)
  GROUP BY {keys}
),
fits AS (
  SELECT *, sqrt(variance) AS se, abs(b1) / sqrt(2 * variance) AS x
  FROM beta_{_NEWTON_STEPS} JOIN aucs USING ({keys})
),
results AS (
  SELECT {keys}, n, error, CASE WHEN error IS NULL THEN true END AS converged,
    b1 AS was_picked_coef,
    {_p_value("x")} AS was_picked_pvalue,
    exp(b1) AS odds_ratio, exp(b1 - 1.959963984540054 * se) AS odds_ratio_ci_low,
    exp(b1 + 1.959963984540054 * se) AS odds_ratio_ci_high,
    1 - log_lik / (wins * ln(wins / n) + (n - wins) * ln(1 - wins / n)) AS pseudo_r2, auc
  FROM groups LEFT JOIN fits USING ({keys})
),
ranked AS (
  SELECT *, CASE WHEN error IS NULL THEN
    least(min(raw) OVER (PARTITION BY error ORDER BY was_picked_pvalue DESC), 1.0)
    END AS was_picked_qvalue
  FROM (SELECT *, was_picked_pvalue * count(*) OVER (PARTITION BY error)
          / count(*) OVER (PARTITION BY error ORDER BY was_picked_pvalue) AS raw FROM results)
),
pooled AS (
  SELECT *, own / all_own AS character_share, own / all_own >= 0.2 AS native_pool
  FROM (SELECT *, sum(n) OVER (PARTITION BY base_card, character_chosen) AS own,
          sum(n) OVER (PARTITION BY base_card) AS all_own
        FROM (SELECT *, regexp_replace(card_name, '\\+1$', '') AS base_card FROM ranked))
)""")
    return _groups(_PAIR) + "," + ",".join(ctes)


_EFFECT_MODELS = """
SELECT character_chosen, card_name, n, error, converged, round(was_picked_coef, 6) AS was_picked_coef,
  round(was_picked_pvalue, 6) AS was_picked_pvalue, round(odds_ratio, 6) AS odds_ratio,
  round(odds_ratio_ci_low, 6) AS odds_ratio_ci_low,
  round(odds_ratio_ci_high, 6) AS odds_ratio_ci_high, round(pseudo_r2, 6) AS pseudo_r2,
  round(auc, 6) AS auc, round(was_picked_qvalue, 6) AS was_picked_qvalue, base_card,
  character_share, native_pool
FROM pooled
"""


def statements() -> dict[str, str]:
    """Expected result per query name."""
    lift = f"SELECT {_LIFT_FIELDS} FROM lift"
    newton = _newton_ctes()
    return {
        "runs_dedup": _sql(f"""
SELECT {_RUN_FIELDS}, coalesce(n_lines, 0) AS n_choices,
  least('landing/' || character_chosen || '.json', 'landing/' || neow_bonus || '.json')
    AS _source_file
FROM book LEFT JOIN per_run USING (k)"""),
        "ingest_runs": _sql(f"""
SELECT {_RUN_FIELDS}, coalesce(n_lines, 0) AS n_choices, 'daily' AS source_folder
FROM book LEFT JOIN per_run USING (k)"""),
        "flatten_structs": _sql(f"""
SELECT {', '.join(f'{name.strip()} AS "event.{name.strip()}"' for name in _RUN_FIELDS.split(','))},
  coalesce(n_lines, 0) AS n_choices
FROM book LEFT JOIN per_run USING (k)"""),
        "json_round_trip": _sql("""
SELECT play_id, pick_num, CAST(floor AS DOUBLE) AS floor, picked,
  first_passed || ',' || second_passed AS not_picked
FROM book JOIN lines USING (k)"""),
        "runs_standard": _sql(f"SELECT {_RUN_FIELDS} FROM standard"),
        "run_checks": _sql("""
SELECT CAST(sum(copies) AS BIGINT) AS n_runs, count(*) AS n_keys, count(*) FILTER (copies > 1) AS duplicate_keys,
  CAST(sum(copies - 1) AS BIGINT) AS excess_rows, CAST(sum(wins) AS BIGINT) AS n_wins
FROM (SELECT play_id, count(*) AS copies, count(*) FILTER (victory) AS wins
      FROM (SELECT play_id, victory FROM book UNION ALL SELECT play_id, victory FROM book WHERE k % 5 = 0)
      GROUP BY play_id)"""),
        "flag_value_counts": _sql("SELECT is_trial, count(*) AS n FROM book GROUP BY is_trial"),
        "floor_value_counts": _sql("""
SELECT floor_reached, count(*) AS n FROM book GROUP BY floor_reached
ORDER BY n DESC, floor_reached LIMIT 50"""),
        "card_value_counts": _sql("""
SELECT card, count(*) AS n FROM picks WHERE card IS NOT NULL GROUP BY card
ORDER BY n DESC, card LIMIT 20"""),
        "distinct_characters": _sql("SELECT DISTINCT character_chosen FROM book"),
        "sample_rows": _sql(f"SELECT {_RUN_FIELDS} FROM book ORDER BY play_id LIMIT 50"),
        "choice_list": _sql("""
SELECT play_id, CAST(floor AS DOUBLE) AS floor, picked,
  first_passed || ',' || second_passed AS not_picked, 2 AS n_not_picked
FROM book JOIN lines USING (k)"""),
        "pick_events": _sql("""
SELECT play_id, pick_num, card, is_selected, choice_floor,
  first_passed || ',' || second_passed AS not_picked_options, floor_reached, victory,
  character_chosen, ascension_level, current_hp, max_hp, relic_count, neow_bonus, neow_cost,
  player_experience, floors_gained
FROM picks"""),
        "pick_stats": _sql("""
SELECT play_id, count(*) AS pick_count, count(*) FILTER (is_selected) AS cards_picked,
  count(*) FILTER (NOT is_selected) AS skip_count
FROM picks GROUP BY play_id"""),
        "skip_rate": _sql(
            "SELECT avg(CAST(NOT is_selected AS INTEGER)) AS skip_rate FROM picks"
        ),
        "pick_describe": _sql("""
SELECT count(floors_gained) AS n, round(avg(floors_gained), 6) AS mean,
  round(stddev_samp(floors_gained), 6) AS std, min(floors_gained) AS min,
  max(floors_gained) AS max, quantile_cont(floors_gained, 0.25) AS p25,
  quantile_cont(floors_gained, 0.5) AS p50, quantile_cont(floors_gained, 0.75) AS p75
FROM picks"""),
        "pick_describe_sketch": _sql("""
SELECT count(floors_gained) AS n, round(avg(floors_gained), 6) AS mean,
  round(stddev_samp(floors_gained), 6) AS std, min(floors_gained) AS min,
  max(floors_gained) AS max, quantile_disc(floors_gained, 0.25) AS p25,
  quantile_disc(floors_gained, 0.5) AS p50, quantile_disc(floors_gained, 0.75) AS p75
FROM picks"""),
        "prepared_picks": _sql("""
SELECT play_id, pick_num, card AS card_selected,
  CASE WHEN is_selected THEN choice_floor END AS card_selected_floor,
  NOT is_selected AS card_not_selected,
  CASE WHEN NOT is_selected THEN choice_floor END AS card_not_selected_floor,
  first_passed || ',' || second_passed AS not_picked_options, floor_reached, victory,
  character_chosen, ascension_level, current_hp, max_hp, relic_count, neow_bonus, neow_cost,
  player_experience, floors_gained
FROM picks"""),
        "prepared_checks": _sql("""
SELECT count(*) AS n_picks, count(*) FILTER (card IS NULL AND floor IS NULL AND is_selected) AS neither_filled,
  count(*) FILTER (card IS NOT NULL AND NOT is_selected) AS both_filled,
  avg(CAST(NOT is_selected AS INTEGER)) AS skip_rate
FROM (SELECT is_selected,
        CASE WHEN k % 13 = 0 THEN 'Brand#0' WHEN NOT (k % 7 = 0 AND is_selected) THEN card END AS card,
        CASE WHEN is_selected AND k % 7 <> 0 THEN choice_floor END AS floor FROM picks)"""),
        "pick_checks": _sql("""
SELECT count(*) AS n_picks, count(*) FILTER (is_selected AND card IS NULL) AS selected_without_card,
  count(*) FILTER (NOT is_selected AND card IS NOT NULL) AS skipped_with_card,
  count(*) FILTER (floors_gained < 0) AS negative_floors_gained,
  avg(CAST(NOT is_selected AS INTEGER)) AS skip_rate
FROM (SELECT is_selected,
        CASE WHEN k % 7 <> 0 THEN card WHEN NOT is_selected THEN 'Brand#0' END AS card,
        CASE WHEN k % 11 = 0 THEN -floors_gained - 1 ELSE floors_gained END AS floors_gained FROM picks)"""),
        "offer_checks": _sql("""
SELECT CAST(sum(options) AS BIGINT) AS n_offers, count(*) AS n_occasions,
  count(*) FILTER (was_skip) AS n_skips, count(*) FILTER (was_skip AND picked > 0) AS skips_with_pick,
  count(*) FILTER (NOT was_skip AND picked <> 1) AS occasions_without_one_pick
FROM (SELECT play_id, pick_num, count(*) AS options, bool_or(was_skip) AS was_skip, count(*) FILTER (
        CASE WHEN CAST(play_id AS BIGINT) % 7 = 0 THEN true WHEN CAST(play_id AS BIGINT) % 11 = 0 THEN false
          ELSE was_picked END) AS picked
      FROM offers GROUP BY play_id, pick_num)"""),
        "offers": _sql(_OFFERS),
        "table_round_trip": _sql(_OFFERS),
        "run_summary": _sql(_SUMMARY),
        "run_summary_joined": _sql(_SUMMARY),
        "tier_offers": _sql(_TIERS, _TIER_CTES),
        "tier_offers_joined": _sql(_TIERS, _TIER_CTES),
        "run_summary_bucketed": _sql(_SUMMARY),
        "tier_offers_bucketed": _sql(_TIERS, _TIER_CTES),
        "stored_pairs": _sql(_STORED_PAIRS),
        "stored_tables": _sql(_STORED, _TIER_CTES),
        "lift_table": _sql(lift),
        "csv_round_trip": _sql(lift),
        "lift_screen": _sql(f"SELECT {_LIFT_FIELDS}, n_not_picked FROM screen"),
        "lift_top_k": _sql(
            f"{_top_lift('floors_gained_lift')} UNION ALL {_top_lift('win_rate_lift')}"
        ),
        "lift_by_ascension": _sql("""
SELECT *, win_rate_picked - win_rate_not_picked AS win_rate_lift
FROM (
  SELECT character_chosen, ascension_level, card_name, count(*) AS n_offered,
    CAST(sum(CAST(was_picked AS INTEGER)) AS BIGINT) AS n_picked,
    avg(CAST(was_picked AS INTEGER)) AS pick_rate,
    avg(CAST(victory AS INTEGER)) FILTER (was_picked) AS win_rate_picked,
    avg(CAST(victory AS INTEGER)) FILTER (NOT was_picked) AS win_rate_not_picked
  FROM offers GROUP BY character_chosen, ascension_level, card_name)"""),
        "floor_adjusted_lift": _sql("""
SELECT character_chosen, card_name, count(*) AS n_floors, CAST(sum(n) AS BIGINT) AS n_compared,
  round(sum((picked - passed) * n) / sum(n), 6) AS floors_gained_adjusted_lift
FROM (SELECT character_chosen, card_name, floor, count(*) AS n,
        avg(floors_gained) FILTER (was_picked) AS picked,
        avg(floors_gained) FILTER (NOT was_picked) AS passed
      FROM offers GROUP BY character_chosen, card_name, floor)
WHERE picked IS NOT NULL AND passed IS NOT NULL GROUP BY character_chosen, card_name"""),
        "popularity_corr": _sql("""
SELECT character_chosen, count(*) AS n_cards,
  round(corr(pick_rate, win_rate_lift), 6) AS corr_pick_rate_win_rate_lift,
  round(corr(pick_rate, floors_gained_lift), 6) AS corr_pick_rate_floors_gained_lift,
  round(corr(win_rate_lift, floors_gained_lift), 6) AS corr_lifts
FROM screen GROUP BY character_chosen"""),
        "model_input": _sql("SELECT * FROM model"),
        "stored_model_input": _sql("SELECT * FROM model"),
        "candidate_pairs": _sql("""
SELECT * FROM model
WHERE (character_chosen, card_name) IN (('AUTOMOBILE', 'Brand#1'), ('BUILDING', 'Brand#2'),
  ('FURNITURE', 'Brand#3+1'), ('MACHINERY', 'Brand#4'))"""),
        "pair_count": _sql("""
SELECT count(*) AS n_distinct FROM (SELECT DISTINCT character_chosen, card_name FROM model)"""),
        "native_pool": _sql("""
SELECT character_chosen, card_name, n, base_card, own / all_own AS character_share,
  own / all_own >= 0.2 AS native_pool
FROM (SELECT *, sum(n) OVER (PARTITION BY base_card, character_chosen) AS own,
        sum(n) OVER (PARTITION BY base_card) AS all_own
      FROM (SELECT character_chosen, card_name, n_offered AS n,
              regexp_replace(card_name, '\\+1$', '') AS base_card FROM lift))"""),
        "fdr_bh": _sql("""
SELECT character_chosen, card_name, n, error, converged, native_pool, was_picked_pvalue,
  odds_ratio, was_picked_qvalue
FROM steps"""),
        "significant": _sql("""
SELECT character_chosen, card_name, n, error, converged, native_pool, was_picked_pvalue,
  odds_ratio, was_picked_qvalue
FROM effects"""),
        "report_summary": _sql("""
SELECT character_chosen, count(*) AS n_significant, count(*) FILTER (odds_ratio > 1) AS n_positive,
  count(*) FILTER (odds_ratio < 1) AS n_negative
FROM effects GROUP BY character_chosen"""),
        "top_bottom": _sql(f"{_side('top', 'DESC')} UNION ALL {_side('bottom', 'ASC')}"),
        "auc_by_group": _sql("""
SELECT character_chosen, card_name, CAST(sum(won) AS BIGINT) AS n_positive,
  CAST(sum(1 - won) AS BIGINT) AS n_negative,
  CASE WHEN sum(won) * sum(1 - won) > 0 THEN
    round(sum(won * (below + ties / 2)) / (sum(won) * sum(1 - won)), 6) END AS auc
FROM (
  SELECT *, sum(1 - won) OVER (PARTITION BY character_chosen, card_name, score) AS ties,
    sum(1 - won) OVER (PARTITION BY character_chosen, card_name ORDER BY score)
      - sum(1 - won) OVER (PARTITION BY character_chosen, card_name, score) AS below
  FROM (SELECT *, floor * 100 + relic_count AS score, CAST(victory AS INTEGER) AS won FROM offers))
GROUP BY character_chosen, card_name"""),
        "logit_2x2": _sql(_two_by_two(_PAIR), _flag_fits(_PAIR)),
        "logit_2x2_separated": _sql(_two_by_two(_PAIR), _SEPARATED + _flag_fits(_PAIR, "separated")),
        "logit_2x2_by_ascension": _sql(_two_by_two(_ASCENSION), _flag_fits(_ASCENSION)),
        "counterfactual_flag_only": _sql(_FLAG_ONLY),
        "counterfactual_shallow": _sql(_SHALLOW_TREES, _tree_ctes(2, 2)),
        "effect_models": _sql(_EFFECT_MODELS, newton),
        "ordered_report": _sql(_HELPED_REPORT, _HELPED + _flag_fits(_PAIR, "helped")),
        "fit_counts": _sql(
            """
SELECT count(*) AS n_groups, count(*) FILTER (error IS NULL) AS n_fitted,
  count(*) FILTER (error IS NULL) AS n_converged, count(*) FILTER (native_pool) AS n_native
FROM pooled""",
            newton,
        ),
        "error_breakdown": _sql(
            "SELECT error, count(*) AS n FROM groups GROUP BY error", _groups(_PAIR)
        ),
        "convergence_breakdown": _sql(
            "SELECT converged, count(*) AS n FROM flag_fits WHERE error IS NULL GROUP BY converged",
            _SEPARATED + _flag_fits(_PAIR, "separated"),
        ),
        "lift_against_effect": _sql(
            """
SELECT character_chosen, card_name, n_offered, win_rate_lift, round(odds_ratio, 6) AS odds_ratio,
  round(was_picked_qvalue, 6) AS was_picked_qvalue,
  odds_ratio > 0.9 AND odds_ratio < 1.1 AS small_controlled_effect
FROM screen JOIN pooled USING (character_chosen, card_name) WHERE error IS NULL""",
            newton,
        ),
    }
