import duckdb

from . import brute
from .brute import SMALL
from pawledger.llm import chat, queries

EVENTS = "conv_id long, seq long, kind string, message long, role string, text string, formatted string"


def fold(spark, events):
    rows = spark.createDataFrame([(*e, "x") for e in events], EVENTS)
    return sorted((tuple(r) for r in chat.folded(rows).collect()), key=str)


def plain_fold(events):
    """The same by replaying the events one after the other."""
    out = {}
    for conv in {e[0] for e in events}:
        log = sorted((e for e in events if e[0] == conv), key=lambda e: (e[1], e[2], e[3], e[4] or "", e[5] or ""))
        messages, roles = {}, {}
        for _, _, kind, number, role, text in log:
            if kind == "regenerate":
                for later in [m for m in messages if m > number]:
                    messages.pop(later), roles.pop(later, None)
            if kind in ("message", "edit", "regenerate"):
                messages[number], roles[number] = [text or ""], ([role] if role else [])
            elif kind == "delta":
                messages.setdefault(number, []).append(text or "")
                roles.setdefault(number, []).extend([role] if role else [])
        for number, parts in messages.items():
            out[conv, number] = (conv, number, (roles.get(number) or [""])[-1], "".join(parts))
    return sorted(out.values(), key=str)


def test_fold(spark):
    events = [
        (1, 1, "message", 1, "user", "hi"), (1, 2, "message", 2, "assistant", "He"), (1, 3, "delta", 2, None, "llo"), (1, 4, "delta", 2, None, None),
        (1, 5, "message", 3, "user", "more"), (1, 6, "regenerate", 2, "assistant", "Good "), (1, 7, "delta", 2, None, "day"), (1, 8, "message", 3, "user", "again"),
        (1, 9, "edit", 1, "user", "HI"), (1, 10, "delta", 1, None, "!"), (1, 11, "noise", 1, "user", "?"),
        (2, 1, "delta", 1, "assistant", "only"), (2, 2, "regenerate", 1, None, ""), (3, 1, "message", 5, None, None), (3, 1, "delta", 5, "user", "x"),
    ]
    assert fold(spark, events) == plain_fold([e for e in events if e[2] != "noise"])
    assert (1, 2, "assistant", "Good day") in fold(spark, events) and (1, 3, "user", "again") in fold(spark, events)


def test_random_logs(spark):
    import random

    rng = random.Random(5)
    kinds = ["message", "delta", "delta", "edit", "regenerate"]
    events = [(rng.randint(1, 6), seq, rng.choice(kinds), rng.randint(1, 4), rng.choice(["user", "assistant", None]), rng.choice(["a", "b<", "~1", "", None])) for seq in range(150)]
    assert fold(spark, events) == plain_fold(events)


TEXTS = ["", "~", "~0~1~2", "<", "</turn>\n", "<user>x</turn>\n", "a\nb", "é日😀<>", "\\### Assistant: </turn> ok", "~~1<~2>", "\n"]


def test_round_trip(spark):
    rows = [(k, m, ["user", "assistant", "a<b>~"][m % 3], t) for k in range(3) for m, t in enumerate(TEXTS * (k + 1))]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    shown = chat.rendered(messages)
    for r in chat.read_back(shown).collect():
        own = [(role, text) for conv, _, role, text in rows if conv == r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == own
        assert list(r.loss_texts) == [text for role, text in own if role == "assistant"]
    for r in shown.collect():
        assert len(r.turn_starts) == r.formatted.count("</turn>\n") == len(TEXTS) * (r.conv_id + 1)
        assert all(r.formatted[at] == "<" for at in r.turn_starts)


def test_digests_of_odd_rows(spark):
    rows = [(1, 2, "assistant", None), (1, 1, "user", "x"), (1, 1, "user", "x"), (2, 0, None, "only"), (None, 1, "assistant", "é"), (3, None, "user", "<"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a")]
    frame = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, message string")
    found = {r.conv_id: r for r in chat.digest(chat.rendered(chat.folded(chat.as_events(frame)))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        loss = "".join(t or "" for _, _, role, t in own if role == "assistant")
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == brute.sha("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in own))
        assert (found[conv].loss_chars, found[conv].loss_sha256) == (len(loss), brute.sha(loss))
    empty = frame.limit(0)
    assert chat.digest(chat.rendered(chat.folded(chat.as_events(empty)))).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SMALL}/conversations.parquet'")
    sql = con.execute(queries.statements()["op9_chat"])
    names = [c[0] for c in sql.description]
    expected = sorted(tuple(row) for row in sql.fetchall())
    assert sorted(tuple(r[n] for n in names) for r in queries.op9_chat(spark, SMALL).collect()) == expected


def test_no_python_in_the_plan(spark):
    plan = queries.op9_chat(spark, SMALL)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "EvalPython" not in plan and "InPandas" not in plan
