import random
import re

from llm.tables import shown

from offerlens.llm import chat

TURNS = "conv_id bigint, turn bigint, role string, text string, n int, hash_1 bigint, whole boolean"


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, True) for row in rows], TURNS)


def plain(rows):
    """Maximal conversations by comparing all lists of turns."""
    convs = {}
    for conv_id, turn, role, text in set(rows):
        convs.setdefault(conv_id, []).append((turn is not None, turn or 0, role is not None, role or "", text))
    lists = {i: tuple((t[3] if t[2] else None, t[4]) for t in sorted(turns, key=lambda t: t[:4])) for i, turns in convs.items()}
    out = []
    for i, own in lists.items():
        if any(other[: len(own)] == own and len(other) > len(own) for other in lists.values()):
            continue
        same = [j for j, other in lists.items() if other == own and j is not None]
        if i != (min(same) if same else None):
            continue
        logged = sum(own[: len(other)] == other for other in lists.values())
        text = "".join(f"<|im_start|>{role or 'none' if role is None else role}\n{t or ''}<|im_end|>\n" for role, t in own)
        out.append((i, len(own), logged, text))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "n_turns", "n_logged", "text")


def test_snapshots_collapse_into_the_longest(spark):
    rng = random.Random(8)
    rows = []
    for family in range(6):
        script = [("user" if k % 2 == 0 else "assistant", rng.choice(["hi", "yes", "no", f"t{family}"])) for k in range(7)]
        for copy in range(5):
            conv = family * 10 + copy
            rows += [(conv, k, *script[k]) for k in range(rng.randrange(1, 8))]
    rows += [(200 + i, 0, "user", "hello") for i in range(50)]  # one common first turn
    rows += [(300, 5, "user", "hello"), (300, 9, None, None), (300, 7, "system", "")]
    rows += [(301, 1, "user", "hello"), (301, 2, "system", ""), (302, 1, None, "x"), (303, 1, "", "x"), (304, None, "user", None)]
    rows += [(None, 0, "user", "lost"), (None, 1, "user", "lost too")]
    rows += rows[:5]
    rng.shuffle(rows)
    assert shown(chat.collapsed_chats(table(spark, rows)), *COLUMNS) == plain(rows)


def test_long_conversation_and_template(spark):
    rows = [(1, k, "user", f"turn {k} " * 50) for k in range(3000)] + [(2, k, "user", f"turn {k} " * 50) for k in range(2999)]
    template = chat.Template("[", "]", "\n")
    got = chat.collapsed_chats(table(spark, rows), template).collect()
    assert [(r.conv_id, r.n_turns, r.n_logged) for r in got] == [(1, 3000, 2)]
    assert got[0].text.startswith("[user]turn 0 ") and got[0].text.count("[user]") == 3000


def test_empty_table_and_no_python(spark):
    df = table(spark, [(1, 0, "user", "a")])
    assert chat.collapsed_chats(df.limit(0)).count() == 0
    plan = chat.collapsed_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
