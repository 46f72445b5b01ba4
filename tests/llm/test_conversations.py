"""Conversation repair against plain dynamic programming and, for short conversations, against all edits."""

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F



def legal(roles):
    body = roles[1:] if roles.startswith("s") else roles
    return roles == "" or (len(body) > 0 and body == "ua" * (len(body) // 2))


def faults(rows):
    """(turn, role, text) of one conversation in order: (rows, blank, duplicate, truncated, illegal, gaps)."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x, t) for t, r, x in rows))
    seen, out, bad = set(), [], 0
    for k, (_, _, role, text, turn) in enumerate(rows):
        bare = text.strip("\t\n\v\f\r ")
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        bad += bool(k) and rows[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        out.append((role, text, kind, turn))
    turns = {t for *_, t in out if t is not None}
    return out, *[sum(k == kind for _, _, k, _ in out) for kind in ("blank", "duplicate", "truncated")], bad, max(turns) - min(turns) + 1 - len(turns) if turns else 0


def options(row):
    role, text, kind, _ = row
    more = 5 * (kind == "truncated")
    yield "D", 2, ()
    if kind not in ("blank", "duplicate"):
        yield "K", more, ((role, text),)
        for r in ("user", "assistant"):
            yield "R", 1 + more, ((r, text),)


INSERTS = [("", 0, ()), *[("I" * len(x), 5 * len(x), tuple((r, "") for r in x)) for n in (1, 2) for x in itertools.product(("user", "assistant"), repeat=n)]]


def every_edit(rows):
    """(cost, audit, rows) of the best of all sequences of edits with at most two inserts in a place."""
    best = None
    for parts in itertools.product(INSERTS, *[x for r in rows for x in (list(options(r)), INSERTS)]):
        given = [g for p in parts for g in p[2]]
        if legal("".join(r[:1] or "-" for r, _ in given)):
            new = (sum(p[1] for p in parts), "".join(p[0] for p in parts), given)
            best = new if best is None or new < best else best
    return best


def programme(rows):
    """(cost, audit, rows) by whole strings for every prefix of the pattern."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(at):
        for _ in range(2):
            for s, (c, e, g) in list(at.items()):
                for r in ("user", "assistant"):
                    if r[0] in follow[s]:
                        at[r[0]] = min(at.get(r[0], (10 ** 9,)), (c + 5, e + "I", [*g, (r, "")]))
        return at

    at = inserted({"": (0, "", [])})
    for row in rows:
        new = {}
        for s, (c, e, g) in at.items():
            for edit, cost, given in options(row):
                to = given[0][0][:1] if given else s
                if not given or (to and to in follow[s]):
                    new[to] = min(new.get(to, (10 ** 9,)), (c + cost, e + edit, [*g, *given]))
        at = inserted(new)
    return min(at[s] for s in ("", "a") if s in at)


def expected(rows):
    out, blank, duplicate, truncated, illegal, gaps = faults(rows)
    cost, audit, given = programme(out)
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in given).encode()).hexdigest()


def conversation(rng, n):
    turns = [None if rng.random() < 0.05 else k + rng.choice([0, 0, 0, 3]) for k in range(n)]
    return [(t, rng.choice(["user", "assistant", "user", "assistant", "system", "sys", "tool", None, ""]), rng.choice(["Hi.", "Well!", "Cut", "One more?", "", " \n", None, "Hi.", f"Ä{k}.", f"b{k}"])) for k, t in enumerate(turns)]


SCHEMA = "conv_id long, turn long, role string, text string, cost string, `a.b` string, _a string"


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(3)
    convs = {i: conversation(rng, rng.randint(1, 14)) for i in range(150)} | {None: conversation(rng, 9), 500: conversation(rng, 700), 501: [(k, "user", "") for k in range(300)], 502: [(1, "user", "Same.")] * 40,
                                                                             503: [(k, "user" if k % 2 else "assistant", f"{k}.") for k in range(301)], 504: [(1, "system", "x" * 200_000 + ".")]}
    rows = [(c, *r, "in", "in", "in") for c, conv in convs.items() for r in conv]
    rng.shuffle(rows)
    return convs, spark.createDataFrame(rows, SCHEMA).repartition(4)


def test_audit(table):
    from kerbline.llm.conversations import audited
    convs, df = table
    got = {r["conv_id"]: tuple(r)[1:] for r in audited(df).collect()}
    assert got == {c: expected(rows) for c, rows in convs.items()}


def test_steps(table):
    from kerbline.llm.conversations import repaired
    convs, df = table
    got = {}
    for r in sorted(repaired(df).collect(), key=lambda r: r["step"]):
        got.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    for c, rows in convs.items():
        _, audit, given = programme(faults(rows)[0])
        steps = got.get(c, [])
        assert "".join(e for e, _, _ in steps) == audit
        assert [(r, t) for e, r, t in steps if e != "D"] == given
        assert all(r is None and t is None for e, r, t in steps if e == "D")


def test_programme_finds_the_best_of_all_edits():
    rng = random.Random(8)
    for _ in range(60):
        rows = faults(conversation(rng, rng.randint(0, 3)))[0]
        assert programme(rows) == every_edit(rows)


def test_survivors_share_their_past():
    """A long conversation leaves few unresolved steps, also where faults follow each other."""
    from kerbline.llm.conversations import Repair
    rng = random.Random(2)
    for seed in range(4):
        done, most = [], 0
        repair = Repair(lambda e, r: done.append(e))                               # noqa: B023
        for k in range(20_000):
            repair.add(rng.choice("uas-") if seed else "ua"[k % 2], "x", f"{k}", rng.random() < 0.1 * seed, rng.random() < 0.2 * seed)
            most = max(most, repair.unresolved)
        repair.finish()
        assert most < (1_500 if seed else 10) and len(done) >= 20_000


def test_damage(spark, table):
    from kerbline.llm.conversations import damage
    convs, df = table
    want = []
    for c, rows in convs.items():
        for turn, role, text in rows:
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                want += [(c, turn, "user" if kind == 4 else role, "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text)] * (2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, damage(df).collect()))) == sorted(map(repr, want))


def test_lost_conversations_and_empty_tables(spark, table):
    from kerbline.llm.conversations import audited, repaired, with_lost
    _, df = table
    some = audited(df.where("conv_id < 3"))
    got = {r["conv_id"]: r for r in with_lost(some, df.where("conv_id < 5 or conv_id is null")).collect()}
    assert set(got) == {0, 1, 2, 3, 4, None}
    assert tuple(got[None]) == (None, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert audited(df.limit(0)).count() == 0 == repaired(df.limit(0)).count()
    assert with_lost(audited(df.limit(0)), df.where("conv_id = 3")).count() == 1


def test_text_ids(spark):
    from kerbline.llm.conversations import audited
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("a", 2, "assistant", "Yes."), ("", 1, "user", "So?")], "c string, n int, r string, x string")
    got = {r["conv_id"]: r["audit"] for r in audited(df, "c", "n", "r", "x").collect()}
    assert got == {"a": "KK", "": "D"}
    assert audited(df.withColumn("c", F.col("c").cast("binary")).limit(0), "c", "n", "r", "x").count() == 0
