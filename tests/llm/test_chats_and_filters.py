"""Chat repair, chat formatting and the filter audit against plain versions and on odd rows."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cindertally.llm import chat_format, chat_queries, chat_repair, filter_audit

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
MARKS = ["<|im_end|>", "<|", "<\\|", "<\\\\|", "|", "<", "\\", "im_start|>", "<|im_next|>", "<|im_line|>", "\n", "a", " ", "\U0001f600"]


def rows_of(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def least(codes):
    """Cost and audit of the cheapest edits, ties ASCII-least: whole audits from the end backwards."""
    table = {(len(codes), 0): (0, ""), (len(codes), 3): (0, ""), (len(codes), 2): (2, "I"), (len(codes), 1): (4, "II")}
    for k in range(len(codes) - 1, -1, -1):
        kind, initial = divmod(codes[k], 4)
        here = {}
        for s in range(4):
            ways = []
            for spent, letters, x in ((0, "", s), *((2 * n, "I" * n, y) for n, y in enumerate({0: (2, 3), 1: (2, 3), 2: (3, 2), 3: (2, 3)}[s], 1))):
                c, a = table[k + 1, x]
                ways.append((c + spent + 3, letters + "D" + a))
                if kind < 2:
                    to = {0: 1 if x == 0 else None, 1: 2 if x != 2 else None, 2: 3 if x == 2 else None, 3: None}[initial]
                    if to is not None:
                        c, a = table[k + 1, to]
                        ways.append((c + spent + kind, letters + "K" + a))
                    c, a = table[k + 1, 3 if x == 2 else 2]
                    ways.append((c + spent + 2 + kind, letters + "R" + a))
            here[s] = min(ways)
        table.update({(k, s): here[s] for s in here})
    return table[0, 0]


def solved(codes):
    ends = chat_repair.crossings(codes, 0, chat_repair.OPEN)
    out, s, cost = "", 0, 0
    for c, t in zip(codes, ends, strict=True):
        spent, letters = chat_repair.ROWS[c][s][t]
        out, cost, s = out + letters, cost + spent, t
    return cost + 2 * len(chat_repair.TAIL[s]), out + chat_repair.TAIL[s]


def test_crossings_give_the_least_audit_of_every_short_conversation():
    for n in range(1, 4):
        for codes in itertools.product(range(12), repeat=n):
            assert solved(codes) == least(codes), codes
    r = random.Random(3)
    for _ in range(300):
        codes = [r.choice([0, 1, 2, 1, 2, 3, 4, 5, 6, 9, 10]) for _ in range(r.randrange(4, 60))]
        assert solved(codes) == least(codes)


def test_blocks_give_what_the_whole_gives():
    r = random.Random(5)
    for _ in range(100):
        codes = [r.choice([0, 1, 2, 1, 2, 3, 5, 6, 9]) for _ in range(r.randrange(2, 50))]
        cut = sorted({0, len(codes), *(r.randrange(1, len(codes)) for _ in range(3))})
        parts = [bytes(codes[a:b]) for a, b in itertools.pairwise(cut)]
        ends = chat_repair.crossings([chat_repair.reduced(p) for p in parts], 0, chat_repair.OPEN)
        done = [chat_repair.letters_of(p, s, e) for p, s, e in zip(parts, [0, *ends], ends, strict=False)]
        tail = chat_repair.TAIL[ends[-1]]
        assert (sum(c for _, c in done) + 2 * len(tail), "".join(a for a, _ in done) + tail) == least(codes)


def expected(rows):
    """A conversation's report from its (turn, role, text) rows, by the plain way."""
    sha = lambda t: hashlib.sha256(t.encode()).digest()
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda q: (q[0] is not None, q[0] or 0, q[1], sha(q[2])))
    seen, codes, n = set(), [], [0, 0, 0, 0]
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = 1 if not body else 2 if (role, text) in seen else 0 if body[-1] in ".!?" else 3
        seen.add((role, text))
        n[fault] += 1
        codes.append(4 * (2 if fault in (1, 2) else 1 if fault == 3 else 0) + (("sua".index(role[:1])) if role[:1] and role[:1] in "sua" else 3))
    cost, audit = least(codes) if codes else (0, "")
    out, s, at = [], 0, 0
    due = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    for letter in audit:
        if letter == "I":
            out.append(due[s] + ":")
            s = 3 if s == 2 else 2
            continue
        _, role, text = rows[at]
        at += 1
        if letter != "D":
            role = due[s] if letter == "R" else role
            out.append(f"{role}:{text}")
            s = {"s": 1, "u": 2, "a": 3}[role[0]]
    turns = [t for t, _, _ in rows if t is not None]
    initials = "".join(o[0] for o in out)
    assert re.fullmatch("(s?(ua)+)?", initials)
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": n[1], "duplicate": n[2], "truncated": n[3], "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def messy(seed, conversations, most):
    r = random.Random(seed)
    out = []
    for c in range(conversations):
        for k in range(r.randrange(1, most)):
            out.append((c, r.choice([k, k, k + 1, None]), r.choice(["user", "assistant", "system", "tool", "", None]), r.choice(["Yes.", "No", "Yes.", "  ", "", None, "ends \t", "what? ", f"own {k}."])))
    return out


@pytest.mark.parametrize("bits", [12, 2])
def test_reports_equal_the_plain_way(spark, monkeypatch, bits):
    monkeypatch.setattr(chat_repair, "BLOCK_BITS", bits)
    rows = messy(bits, 30, 25) + [(None, 0, "user", "a."), (None, None, "assistant", "b")]
    rows += [(99, 0, "user", "same.")] * 40  # copies of one row
    df = spark.createDataFrame(rows, TURNS)
    got = rows_of(chat_repair.repair_report(df, df), "conv_id")
    for c in {r[0] for r in rows}:
        assert {k: v for k, v in got[c].items() if k != "conv_id"} == expected([r[1:] for r in rows if r[0] == c]), c
    assert len(got) == len({r[0] for r in rows})


def test_repaired_turns_are_rows(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why.")], TURNS)
    places = chat_repair.placed(df)
    turns = chat_repair.repaired(df, chat_repair.audits(places)).orderBy("place").collect()
    assert [(t.place, t.edit, t.turn, t.role, t.text) for t in turns] == [(0, "I", None, "user", ""), (1, "K", 0, "assistant", "Hello."), (2, "K", 2, "user", "Why."), (3, "I", None, "assistant", "")]


def test_repair_of_conversations_without_rows_and_of_empty_tables(spark):
    df = spark.createDataFrame([(5, 0, "user", "x.")], TURNS).withColumn("digest", F.lit(1)).withColumn("pos", F.lit("clash"))
    r = chat_repair.repair_report(df, df.filter("false")).collect()[0]
    assert (r.cost, r.audit, r.repaired_sha256) == (0, "", hashlib.sha256(b"").hexdigest())
    assert chat_repair.repair_report(df.filter("false"), df.filter("false")).count() == 0


def test_damage_codes(spark, sf):
    """Every code occurs, and rows are what the codes say."""
    import zlib

    raw = spark.read.parquet(f"{sf}/conversations.parquet")
    got = [tuple(r) for r in chat_queries.damaged(raw).collect()]
    want = []
    for r in raw.collect():
        code = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        if code:
            text = "" if code == 1 else re.sub("[.!?]", "", r.text) if code == 2 else r.text
            want += [(r.conv_id, r.turn, "user" if code == 4 else r.role, text)] * (2 if code == 3 else 1)
    assert sorted(got) == sorted(want)


def test_format_reads_back_whatever_the_texts_hold(spark):
    r = random.Random(1)
    rows = [(c, k, r.choice(["user", "assistant", "assistant", "<|im_end|>", "a\nb", None]), r.choice([None, "", "".join(r.choice(MARKS) for _ in range(r.randrange(9)))])) for c in range(60) for k in range(r.randrange(1, 9))]
    df = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("clash"))
    made = chat_format.formatted(df)
    read = rows_of(made.withColumn("turns", chat_format.parsed(F.col("formatted"))), "conv_id")
    said = rows_of(chat_format.digests(made), "conv_id")
    for c in range(60):
        own = [(x[2] or "", x[3] or "") for x in sorted((x for x in rows if x[0] == c), key=lambda x: x[1])]
        assert [tuple(t) for t in read[c]["turns"]] == own
        text, at, loss = read[c]["formatted"], 0, ""
        for skip, take in read[c]["loss"]:
            loss += re.sub(r"<\\(\\*)\|", r"<\1|", text[at + skip : at + skip + take])
            at += skip + take
        assert text[at:] == "<|im_end|>\n"
        plain = "".join(t for role, t in own if role == "assistant")
        assert loss == plain
        assert said[c]["loss_sha256"] == hashlib.sha256(plain.encode()).hexdigest() and said[c]["loss_chars"] == len(plain)
        assert said[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert said[c]["n_turns"] == len(own) and said[c]["n_runs"] == len(list(itertools.groupby(x[0] for x in own)))
        assert text.count("<|im_start|>") == said[c]["n_runs"]
    assert chat_format.digests(chat_format.formatted(df.filter("false"))).count() == 0


def plain_audit(rows, labels):
    """Counts by going through all orders, row by row."""
    good, toxic = ({d for d, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for i, text, _ in rows:
        text = text or ""
        ws = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails.append((len(ws) < 100, 100 * len(set(ws)) < 80 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and any(j is not None and j < i and (u or "") == text for j, u, _ in rows)))
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                x = "ABCDE".index(f)
                gone = [k for k in left if fails[k][x]]
                out[part, "".join(order), step] = [len(left) - len(gone), len(gone), sum(fails[k][x] for k in own if k not in left), sum(fails[k][x] and sum(fails[k]) == 1 for k in own), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
                total[f] += len(gone)
                left = [k for k in left if k not in gone]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_filter_audit_equals_going_through_all_orders(spark):
    r = random.Random(2)
    texts = [None, "", "same words " * 60, " ".join(f"w{k}" for k in range(120)), " ".join(f"w{k}" for k in range(120)), "SHOUTING LOUD", "cost $5 & more", "é" * 5000, " ".join(f"Q{k}|" for k in range(130))]
    rows = [(r.choice([*range(40), None]), r.choice(texts), r.choice(["en", "fr", None])) for _ in range(90)]
    labels = [(r.choice([*range(40), None]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], DOCS).withColumn("bits", F.lit("clash")).withColumn("mask", F.lit(1)).withColumn("good", F.lit(9))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("lang", F.lit("clash"))
    got = {(x.part, x.filter_order, x.step): [x[c] for c in filter_audit.COUNTS] for x in filter_audit.filter_audit(docs, marks).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.filter_audit(docs.filter("false"), marks).count() == 0
    assert filter_audit.filter_audit(docs, marks.filter("false")).count() == 3 * 600


@pytest.mark.parametrize("name", sorted(chat_queries.QUERIES))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = chat_queries.QUERIES[name](spark, sf).toPandas(), con.sql(chat_queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
    assert key(got) == key(want)
