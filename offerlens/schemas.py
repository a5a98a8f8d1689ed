"""Schemas, as DDL strings, of the record source and of the tables and results built from it."""

# Field names and types of a run. Floors inside choices stay double, as they are
# compared before they are cut to whole floors.
RUN_FIELDS = """
    play_id string,
    character_chosen string,
    ascension_level bigint,
    victory boolean,
    floor_reached bigint,
    is_endless boolean,
    is_daily boolean,
    is_trial boolean,
    chose_seed boolean,
    card_choices array<struct<floor: double, picked: string, not_picked: array<string>>>,
    current_hp_per_floor array<bigint>,
    max_hp_per_floor array<bigint>,
    gold_per_floor array<bigint>,
    relics_obtained array<struct<floor: double, key: string>>,
    relics array<string>,
    boss_relics array<struct<picked: string, not_picked: array<string>>>,
    path_taken array<string>,
    path_per_floor array<string>,
    potions_obtained array<struct<floor: double, key: string>>,
    campfire_choices array<struct<floor: double, key: string, data: string>>,
    master_deck array<string>,
    items_purged array<string>,
    purchased_purges bigint,
    score bigint,
    playtime bigint,
    gold bigint,
    campfire_rested bigint,
    campfire_upgraded bigint,
    neow_bonus string,
    neow_cost string,
    killed_by string,
    player_experience bigint,
    build_version string,
    win_rate double
"""



def field_types(fields: str) -> dict[str, str]:
    """Name and type of each line of a field list."""
    return dict(line.strip().rstrip(",").split(" ", 1) for line in fields.strip().splitlines())


RUN_TYPES = field_types(RUN_FIELDS)

# A raw record: the wrapper's content as JSON text, which keeps every field and every digit.
RECORD_SCHEMA = "event string"

# What is read out of it. Whole numbers stay text at first, as sources write both 7 and 7.0.
EVENT_SCHEMA = ", ".join(
    f"{name} {kind.replace('bigint', 'string')}" for name, kind in RUN_TYPES.items()
)

PICK_FIELDS = """
    play_id string,
    pick_num int,
    card string,
    is_selected boolean,
    choice_floor int,
    not_picked_options array<string>,
    floor_reached bigint,
    victory boolean,
    character_chosen string,
    ascension_level bigint,
    current_hp bigint,
    max_hp bigint,
    relic_count int,
    neow_bonus string,
    neow_cost string,
    player_experience bigint,
    floors_gained bigint
"""

PICK_TYPES = field_types(PICK_FIELDS)

EFFECT_FIELDS = """
    n bigint,
    error string,
    converged boolean,
    was_picked_coef double,
    was_picked_pvalue double,
    odds_ratio double,
    odds_ratio_ci_low double,
    odds_ratio_ci_high double,
    pseudo_r2 double,
    auc double
"""

OUTCOME_EFFECT_FIELDS = """
    n bigint,
    error string,
    was_picked_effect double,
    was_picked_importance bigint
"""
