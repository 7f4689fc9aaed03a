import heapq
import random
import time

from masterloom.llm.repair import apply_edits, cheapest, faults, repair_conversations

from .helpers import clashing, frame

ROWS = "conv_id long, turn long, role string, text string"


def accepted(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return not initials or (rest and len(rest) % 2 == 0 and all(x == "ua"[k % 2] for k, x in enumerate(rest)))


def brute(initials, found):
    """Cheapest edits by trying all of them in order of (cost, edits), roles spelt out."""
    queue = [(0, "", 0, "")]
    best = None
    while queue:
        cost, edits, at, out = heapq.heappop(queue)
        if best is not None and cost > best[0]:
            break
        if at == len(initials) and accepted(out):
            best = min(best or (cost, edits), (cost, edits))
        if len(out) > len(initials) + 2:
            continue
        for role in "ua":
            heapq.heappush(queue, (cost + 3, edits + "I", at, out + role))
        if at < len(initials):
            heapq.heappush(queue, (cost + 4, edits + "D", at + 1, out))
            if found[at] in ("", "truncated"):
                extra = 3 if found[at] else 0
                heapq.heappush(queue, (cost + extra, edits + "K", at + 1, out + (initials[at] or "?")))
                for role in "ua":
                    heapq.heappush(queue, (cost + 3 + extra, edits + "R", at + 1, out + role))
    return best


def test_cheapest_equals_brute_force():
    rng = random.Random(3)
    for _ in range(250):
        n = rng.randrange(5)
        initials = tuple(rng.choice(["s", "u", "a", "u", "a", "t", ""]) for _ in range(n))
        found = tuple(rng.choice(["", "", "", "truncated", "blank", "duplicate"]) for _ in range(n))
        assert cheapest(initials, found) == brute(initials, found), (initials, found)


def test_edits_lead_to_order():
    rng = random.Random(4)
    for _ in range(300):
        n = rng.randrange(40)
        turns = [(rng.choice(["system", "user", "assistant", "tool", " "]), rng.choice(["yes.", "no", "", "a b?", "yes."]))
                 for _ in range(n)]
        found = faults(turns)
        cost, audit = cheapest(tuple(r[:1] for r, _ in turns), tuple(found))
        out = apply_edits(turns, audit)
        assert accepted("".join(r[0] for r, _ in out))
        read = iter(range(n))
        spent = 0
        for edit in audit:
            at = None if edit == "I" else next(read)
            spent += {"D": 4, "I": 3, "K": 0, "R": 3}[edit] + (3 if edit in "KR" and found[at] == "truncated" else 0)
            assert edit == "D" or at is None or found[at] in ("", "truncated")
        assert spent == cost and next(read, None) is None


def test_long_conversations_take_linear_time():
    rng = random.Random(5)
    for kinds in ("ua", "suat", "s", "u"):
        initials = tuple(rng.choice(kinds) for _ in range(20_000))
        found = tuple(rng.choice(["", "truncated"]) for _ in initials)
        started = time.time()
        cost, audit = cheapest(initials, found)
        assert time.time() - started < 20 and len(audit) >= 20_000


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first as its turn is null."), (1, 0, "assistant", None), (1, 0, "assistant", "Ja."), (1, 0, "assistant", "Ja."),
        (2, 5, None, "role is a space"), (2, 9, "user", "\t\n"), (None, 1, "user", "x" * 500_000 + "."), (None, 2, "assistant", "End!\n"),
        (3, 1, "", ""), (4, 1, "system", "s."), (5, 1, "user", "b?"), (5, 1, "user", "a?"), (6, None, None, None),
    ]
    got = {r["conv_id"]: r.asDict(recursive=True) for r in repair_conversations(clashing(frame(spark, rows, ROWS))).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, None}
    one = got[1]
    assert (one["gaps"], one["blank"], one["duplicate"], one["truncated"], one["illegal"]) == (0, 1, 1, 0, 2)
    assert (one["cost"], one["audit"]) == (8, "KDKD") and [t["text"] for t in one["repaired"]] == ["first as its turn is null.", "Ja."]
    assert (got[2]["gaps"], got[2]["blank"], got[2]["truncated"], got[2]["audit"], got[2]["repaired"]) == (3, 1, 1, "DD", [])
    assert (got[None]["cost"], got[None]["audit"]) == (0, "KK") and len(got[None]["repaired"][0]["text"]) == 500_001
    assert (got[3]["cost"], got[3]["audit"], got[4]["audit"]) == (4, "D", "D")
    # Equal turns are ordered by role and text.
    assert got[5]["cost"] == 3 and got[5]["repaired"][0] == {"role": "user", "text": "a?"}
    assert (got[6]["gaps"], got[6]["blank"], got[6]["audit"]) == (0, 1, "D")
    assert repair_conversations(frame(spark, [], ROWS)).count() == 0
    assert repair_conversations(frame(spark, [(1,)], "conv_id long")).first()["audit"] == "D"


def test_dropped_conversations_stay(spark, tmp_path):
    from pyspark.sql import functions as F

    from masterloom.llm.query_repair import damaged, op11_conversation_repair

    ids = spark.range(400).select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"),
                                  F.lit("Hi.").alias("text"))
    ids.unionByName(frame(spark, [(None, None, None, None)], ROWS)).write.parquet(str(tmp_path / "conversations.parquet"))
    left = damaged(ids).select("conv_id").distinct().count()
    got = op11_conversation_repair(spark, str(tmp_path)).collect()
    assert left < 400 and len(got) == 401
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert sum((r["audit"], r["repaired_sha256"], r["blank"], r["cost"]) == ("", empty, 0, 0) for r in got) >= 400 - left
