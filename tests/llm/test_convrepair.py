import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from coppice.llm import convrepair

SCHEMA = "conv_id long, turn long, role string, text string, pos string, code string, live string, copy string, audit string, draw string, n string"
GOOD = re.compile(r"(s?(ua)+)?")


def brute(codes):
    """All edit strings of bounded length, tried one by one."""
    best = None
    for inserts in range(len(codes) + 3):
        for places in itertools.combinations_with_replacement(range(len(codes) + 1), inserts):
            for own in itertools.product("DKR", repeat=len(codes)):
                if any(c == "d" and e != "D" for c, e in zip(codes, own, strict=True)):
                    continue
                cost = 3 * inserts + sum({"D": 4, "K": 0, "R": 3}[e] + (3 if e != "D" and c.isupper() else 0) for c, e in zip(codes, own, strict=True))
                if best and cost > best[0]:
                    continue
                audit, kinds = "", []  # None: user or assistant, as it fits
                for i in range(len(codes) + 1):
                    audit += "I" * places.count(i)
                    kinds += [None] * places.count(i)
                    if i < len(codes):
                        audit += own[i]
                        kinds += [] if own[i] == "D" else [codes[i].lower() if own[i] == "K" else None]
                head = kinds[:1] == ["s"]
                form = ("s" if head else "") + "".join("ua"[(k - head) % 2] for k in range(head, len(kinds)))
                if GOOD.fullmatch(form) and all(k in (None, f) for k, f in zip(kinds, form, strict=True)) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def plain(rows):
    """The query's rows by the rule, one conversation after the other."""
    convs = defaultdict(list)
    shown = lambda x: " " if x is None else str(x)
    for conv, turn, role, text, *_ in rows:
        d = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
        role, text = "user" if d == 4 else shown(role), "" if d == 1 else re.sub("[.!?]", "", shown(text)) if d == 2 else shown(text)
        convs[conv] += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, codes, n = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = brute(codes) if len(codes) <= 3 else convrepair.solve(codes)
        lines, i = [], 0
        for e in audit:
            head = bool(lines) and lines[0].startswith("s")
            fits = "user" if (len(lines) - head) % 2 == 0 else "assistant"
            if e in "KR":
                lines.append(f"{own[i][1] if e == 'K' else fits}:{own[i][2]}")
            elif e == "I":
                lines.append(f"{fits}:")
            i += e != "I"
        out[conv] = (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def rows():
    rng = random.Random(11)
    out = []
    texts = ["Yes.", "No", "Yes.", "Why?", " ", "", None, "Hm!\n", "a:b.", "\x0b.\x0c", "So. x", "é…", "Ja。", "Go."]
    for conv in range(400):
        turn = 0
        for _ in range(rng.randrange(0, 7)):
            turn += rng.choice([1, 1, 1, 0, 3])
            out.append((conv, rng.choice([turn] * 9 + [None]), rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "ux"]), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.randrange(9)}."))
    out += [(1000, i, ["user", "assistant"][i % 3 % 2], f"Row {i}" + "."[: i % 7]) for i in range(3000)]
    out += [(None, i, ["user", "assistant"][i % 2], f"Row {i}.") for i in range(5)]
    out += [(2000 + k, None, "user", "Alone.") for k in range(30)]
    out += [(3000, 1, "user", "long " * 300_000 + ".")] + [(3000, 2, "assistant", "ok.")] * 3
    return [(*r, *["z"] * 7) for r in out]


def test_signatures_by_brute_force():
    for n in range(4):
        for codes in itertools.product("suaxdSUAX" if n < 3 else "suxdUA", repeat=n):
            assert convrepair.solve("".join(codes)) == brute("".join(codes)), codes
    rng = random.Random(3)
    for _ in range(12):
        codes = "".join(rng.choice("suaxdSUAX") for _ in range(4))
        assert convrepair.solve(codes) == brute(codes)


def test_long_signatures():
    cost, audit = convrepair.solve("s" + "ua" * 50_000)
    assert (cost, audit) == (0, "K" * 100_001)
    assert convrepair.solve("u" * 3000)[0] == 3 * 1500 and convrepair.solve("d" * 5000) == (20_000, "D" * 5000)


@pytest.fixture(scope="module")
def answer(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("conv"))
    spark.createDataFrame(rows(), SCHEMA).repartition(7).write.parquet(f"{path}/conversations.parquet")
    return path, {r.conv_id: tuple(r) for r in convrepair.op13_conversation_repair(spark, path).collect()}


def test_query_against_the_plain_rule(answer):
    want = plain(rows())
    assert set(answer[1]) == set(want)
    for conv in want:
        assert answer[1][conv] == want[conv], conv
    assert any(r[7] == "" and r[6] == 0 for r in want.values())  # conversations all of whose rows were dropped


def test_query_against_sql(answer):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{answer[0]}/conversations.parquet/*.parquet'")
    got = {r[0]: r for r in db.execute(convrepair.OP13_SQL).fetchall()}
    assert got == answer[1]


def test_repaired_rows_are_good_conversations(spark):
    given = spark.createDataFrame(rows(), SCHEMA).select("conv_id", "turn", "role", "text")
    done, audits = convrepair.repaired(given)
    convs = defaultdict(list)
    for r in sorted(done.collect(), key=lambda r: r.position):
        convs[r.conv_id].append(r)
    assert all(GOOD.fullmatch("".join(r.role[0] for r in own)) and [r.position for r in own] == list(range(1, len(own) + 1)) for own in convs.values())
    by_id = {r.conv_id: r.audit for r in audits.collect()}
    assert all("".join(r.edit for r in convs[k]) == a.replace("D", "") for k, a in by_id.items())


def test_empty_table(spark):
    done, audits = convrepair.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert done.collect() == [] and audits.collect() == []
