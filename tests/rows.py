"""Hand-written runs for the unit tests."""

from offerlens.schemas import RUN_FIELDS

BASE = {
    "play_id": "a", "character_chosen": "RED", "ascension_level": 3, "victory": True,
    "floor_reached": 50, "is_endless": False, "is_daily": False, "is_trial": False,
    "chose_seed": False, "neow_bonus": "gold", "neow_cost": "none", "player_experience": 7,
    "relics": ["r1", "r2"], "path_taken": ["E", "?", "T", "$", "E", "M"],
    "potions_obtained": [], "score": 10, "playtime": 20, "gold": 30, "campfire_rested": 1,
    "campfire_upgraded": 2,
}


def choice(floor, picked="X", not_picked=("Y", "Z")):
    return {"floor": floor, "picked": picked, "not_picked": list(not_picked)}


def run(**fields):
    fields.setdefault("card_choices", [choice(10.0)])
    return BASE | fields


def runs(spark, *records):
    names = [line.split()[0] for line in RUN_FIELDS.strip().splitlines()]
    return spark.createDataFrame([{n: r.get(n) for n in names} for r in records], RUN_FIELDS)
