"""Fill-in-middle, chat formatting and conversation repair against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratavox.llm import chat_format, conversation_repair, fill_in_middle

CLASHES = ("fim_text", "fim_form", "path", "above", "chunk", "key", "kinds", "code", "loss", "formatted", "same", "n", "fault")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def clashing(df):
    for c in CLASHES:
        df = df.withColumn(c, F.lit("clash"))
    return df


# op 11

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t-\r]+|[^ \t-\r]+", "char": r"(?s)."}
TEXTS = [(1, "a\nb\n\nc"), (2, ""), (3, None), (4, "\n\n\n"), (5, "one line"), (6, "é\n日本\n\n语 x\n"), (7, "has <P> in it\nand more"), (8, "<S><M>"), (9, "a\r\nb\x0bc\n"), (10, "x\n" * 3000 + "y" * 5000), (None, "no\nid\n"), (1, "a\nb\n\nc"), (11, "<P\n>\nnone <\nS>\n")]


def cut_by_force(doc_id, text, unit="line", rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(PATTERN[unit], text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < spm_rate
    return len(units), "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("unit", "rate", "spm_rate"), [("line", 100, 50), ("word", 60, 0), ("char", 100, 100)])
def test_cuts_equal_brute_force(spark, unit, rate, spm_rate):
    docs = clashing(spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3))
    rows = fill_in_middle.transform(docs, unit, rate, spm_rate).withColumn("back", fill_in_middle.restore(F.col("fim_text"), F.col("fim_form"))).collect()
    got = sorted(((r.doc_id, r.text, (r.fim_units, r.fim_form, r.prefix_chars, r.middle_chars, r.fim_text)) for r in rows), key=repr)
    assert got == sorted(((i, t, cut_by_force(i, t, unit, rate, spm_rate)) for i, t in TEXTS), key=repr)
    assert all(r.back == (r.text or "") and r.path == "clash" for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab\n \té日", max_size=30), st.sampled_from(fill_in_middle.UNITS))
def test_places_of_all_units(text, unit):
    data = np.frombuffer(text.encode(), np.uint8)
    units = re.findall(PATTERN[unit], text)
    found = fill_in_middle.runs(data, unit)
    assert found.n == len(units)
    assert [found.place(k) for k in range(found.n + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


def test_cut_query(spark, tmp_path):
    spark.createDataFrame(TEXTS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r) for r in fill_in_middle.op11_fill_in_middle(spark, str(tmp_path)).collect()}
    want = set()
    for i, t in TEXTS:
        n, form, p, m, out = cut_by_force(i, t)
        want.add((i, n, form, p, m, sha(out), sha(t or "")))
    assert got == want
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle.transform(spark.createDataFrame(TEXTS, "doc_id long, text string"), "page")
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# op 12


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet="a:# \\", max_size=6), st.text(alphabet="#</turn>\\\n :x", max_size=25)), max_size=4))
def test_turns_come_back(turns):
    t = chat_format.Template()
    made = "".join(t.turn(r, s)[0] for r, s in turns)
    assert list(chat_format.parse(made)) == turns
    for r, s in turns:
        out, start, stop = t.turn(r, s)
        assert chat_format.unescape(out[start:stop]) == s


def test_template_refuses_control_strings_that_overlap_themselves():
    for bad in ("x", "aba", "a\\b", "##"):
        with pytest.raises(ValueError, match="control"):
            chat_format.Template(head=bad)
    assert list(chat_format.parse(chat_format.Template("<|", "|>", "|.").turn("u", "a|>b|.")[0], chat_format.Template("<|", "|>", "|."))) == [("u", "a|>b|.")]


MESSAGES = "conv_id long, msg_id long, parent_id long, score double, role string, text string"


def trees_by_force(rows, branches):
    """(conv, leaf) -> turns, in the order of rank."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = {}
        for _, i, parent, score, role, text in (r for r in rows if r[0] == conv):
            own.setdefault(chat_format.LEAST if i is None else i, []).append((parent, score or 0.0, role or "", text or ""))
        node = {i: (min((p for p, *_ in v if p is not None), default=None), max(s for _, s, *_ in v)) for i, v in own.items()}
        parent = {i: p if p in node and p < i else None for i, (p, _) in node.items()}
        ranked = []
        for leaf in set(node) - set(parent.values()):
            path = [leaf]
            while parent[path[-1]] is not None:
                path.append(parent[path[-1]])
            ranked.append((-round(sum(node[i][1] for i in path) / len(path), 9), -len(path), leaf, path[::-1]))
        for *_, leaf, path in sorted(ranked)[:branches]:
            out[conv, leaf] = [(role, text) for i in path for _, _, role, text in sorted(own[i], key=lambda x: x[2:])]
    return out


def forest():
    r = random.Random(3)
    rows = [(c, i, r.choice([None, *range(max(0, i - 4), i)]) if i else None, r.choice([0.0, 0.5, 1.0]), r.choice(["user", "assistant"]), f"t{i} {c}") for c in range(6) for i in range(r.randrange(1, 30))]
    rows += [(7, i, i - 1, None, "user", f"long {i}") for i in range(70)]  # one long path; the first has no parent
    rows += [(8, 0, None, 1.0, "user", "root")] + [(8, i, 0, float(i % 3), "assistant", None) for i in range(1, 40)]
    rows += [(9, 1, 2, 0.0, "user", "a"), (9, 2, 1, 0.0, "user", "b"), (9, 3, 3, 0.0, None, "itself"), (9, 4, 99, 0.0, "user", "orphan")]
    rows += [(10, 1, None, 0.0, "user", "x"), (10, 1, None, 2.0, "user", "x"), (10, 1, None, 0.0, "assistant", "tie"), (10, None, None, 0.0, "system", "no id"), (10, 2, 1, 0.0, "assistant", "y" * 10000)]
    return rows + [(None, 1, None, 0.0, "user", "no conversation")]


@pytest.mark.parametrize("branches", [1, 3, None])
def test_paths_equal_brute_force(spark, branches):
    rows = forest()
    found = chat_format.format_trees(clashing(spark.createDataFrame(rows, MESSAGES).repartition(4)), branches).collect()
    want = trees_by_force(rows, branches)
    assert {(r.conv_id, r.path): list(chat_format.parse(r.formatted)) for r in found} == want
    assert len(found) == len(want)
    for r in found:
        under = "".join(chat_format.unescape(r.formatted[s.start : s.stop]) for s in r.loss)
        assert under == "".join(t for role, t in want[r.conv_id, r.path] if role == "assistant") and r.n_turns == len(want[r.conv_id, r.path])


def test_no_messages(spark):
    assert chat_format.format_trees(spark.createDataFrame([], MESSAGES)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def conversations(r, n=60):
    rows = []
    for c in range(n):
        for t in range(r.randrange(1, 9)):
            rows.append((c, t + (t > 3), r.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), r.choice(["Yes.", "No!", "cut off", "", " ", "Yes.", None, f"own {c} {t}?", "end. \t\n"])))
    rows += [(None, 1, "user", "hi."), (None, None, "user", "first."), (None, 2, None, "x."), (500, 1, "user", "a."), (500, 1, "user", "a."), (500, 2, "assistant", "b" * 20000 + "."), (501, 5, "user", "### x: </turn>\n\\")]
    return rows


def test_chat_query(spark, tmp_path):
    rows = conversations(random.Random(1))
    spark.createDataFrame(rows, TURNS).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    added = r"\### Assistant: </turn> ok"
    rows = rows + [(-7, 0, "user", added), (-7, 1, "assistant", added)]
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        loss = "".join(x for _, _, role, x in own if role == "assistant")
        want[conv] = (len(own), sha("".join(f"{role}\n{x}\n" for _, _, role, x in own)), len(loss), sha(loss))
    got = chat_format.op12_chat_formatting(spark, str(tmp_path)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == want and len(got) == len(want)


# op 13


def initials_ok(s):
    return re.fullmatch(r"(s?(ua)+)?", s) is not None


def repair_by_force(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, repaired) of ordered rows (role, text), by least (cost, audit) of every state."""
    seen, faults = set(), []
    for role, text in rows:
        stem = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not stem else "duplicate" if (role, text) in seen else "truncated" if stem[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {"": (0, "", [])}  # by what was last: "" nothing
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def grown(states):
        todo = list(states.items())
        while todo:
            state, (cost, audit, out) = todo.pop()
            for to in follows[state].replace("s", ""):
                way = (cost + 5, audit + "I", [*out, (name[to], "")])
                if len(audit) < 40 and (to not in states or way[:2] < states[to][:2]):
                    states[to] = way
                    todo.append((to, way))
        return states

    for (role, text), fault in zip(rows, faults, strict=True):
        states, new = grown(dict(best)), []
        for state, (cost, audit, out) in states.items():
            new.append((state, (cost + 2, audit + "D", out)))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if role[:1] and role[:1] in follows[state]:
                    new.append((role[:1], (cost + more, audit + "K", [*out, (role, text)])))
                new += [(to, (cost + 1 + more, audit + "R", [*out, (name[to], text)])) for to in follows[state].replace("s", "")]
        best = {}
        for state, way in new:
            best[state] = min(way, best.get(state, way))
    cost, audit, out = min(way for state, way in grown(best).items() if state in ("", "a"))
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def test_the_programme_equals_trying_everything():
    """On up to three rows: every audit with up to three insertions at each place."""
    name = {"u": "user", "a": "assistant"}
    for roles in itertools.chain(*(itertools.product(["system", "user", "assistant", "x"], repeat=n) for n in (1, 2, 3))):
        for ends in itertools.product(".-", repeat=len(roles)):
            rows = [(r, f"{i}{e}") for i, (r, e) in enumerate(zip(roles, ends, strict=True))]
            ways = [(0, "", "")]
            for role, text in [*rows, (None, None)]:
                ways = [(c + 5 * k, a + "I" * k, s + "".join(p)) for c, a, s in ways for k in range(3) for p in itertools.product("ua", repeat=k)]
                if role is not None:
                    more = 0 if text[-1] == "." else 5
                    ways = [w for c, a, s in ways for w in [(c + 2, a + "D", s), (c + more, a + "K", s + role[0]), (c + more + 1, a + "R", s + "u"), (c + more + 1, a + "R", s + "a")]]
                ways = [w for w in ways if w[0] <= 2 * len(rows) and re.fullmatch(r"s?(ua)*u?", w[2])]
            want = min(w for w in ways if initials_ok(w[2]))
            kinds = bytes(4 * "suax".index(r[0][0]) + (r[1][-1] == "-") for r in rows)
            cost, states, tail = conversation_repair.through([conversation_repair.table(kinds)])
            audit = "".join(conversation_repair.CODES[c] for c in conversation_repair.edits(kinds, *states[0])[0]) + "I" * tail
            assert (cost, audit) == want[:2] == repair_by_force(rows)[4:6], (rows, want, name)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(range(16)), min_size=1, max_size=40), st.integers(1, 9))
def test_chunks_compose(kinds, size):
    whole = bytes(kinds)
    parts = [whole[i : i + size] for i in range(0, len(whole), size)]
    cost, states, tail = conversation_repair.through([conversation_repair.table(p) for p in parts])
    once = conversation_repair.through([conversation_repair.table(whole)])
    codes = [c for p, s in zip(parts, states, strict=True) for c in conversation_repair.edits(p, *s)[0]]
    assert (cost, tail, codes) == (once[0], once[2], conversation_repair.edits(whole, *once[1][0])[0])


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 0:
            continue
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        out += [(conv, turn, "user" if f == 4 else role, text)] * (2 if f == 3 else 1)
    return out


@pytest.mark.parametrize("chunk", [3, 8192])
def test_repair_query(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(conversation_repair, "CHUNK", chunk)
    rows = conversations(random.Random(2), 200)
    clashing(spark.createDataFrame(rows, TURNS)).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    digest = lambda c, role, text: hashlib.md5(f"{' ' if c is None else c}:{len(role)}:{role}{text}".encode()).digest()
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, role, digest(conv, role, text), text) for c, t, role, text in damaged(rows) if c == conv))
        turns = [t for known, t, *_ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        *counts, cost, audit, repaired = repair_by_force([(role, text) for *_, role, _, text in own])
        want[conv] = (gaps, *counts, cost, audit, sha(repaired))
    got = conversation_repair.op13_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_no_conversations(spark, tmp_path):
    reports, edits, turns = conversation_repair.repair(spark.createDataFrame([], TURNS))
    assert reports.count() == edits.count() == turns.count() == 0
    spark.createDataFrame([(1, 3, "user", "gone")], TURNS).where("false").write.parquet(f"{tmp_path}/conversations.parquet")
    assert conversation_repair.op13_conversation_repair(spark, str(tmp_path)).count() == 0


def test_repaired_turns_are_in_order(spark):
    rows = [(1, 0, "assistant", "hello."), (1, 1, "assistant", "again."), (1, 2, "user", "cut"), (1, 3, "system", "Be kind.")]
    reports, edits, turns = conversation_repair.repair(spark.createDataFrame(rows, TURNS))
    report = reports.first()
    assert (report.cost, report.audit) == repair_by_force([r[2:] for r in rows])[4:6]
    out = [(r.role, r.text) for r in turns.orderBy("chunk", "at", "k").collect()]
    assert "\n".join(f"{r}:{t}" for r, t in out) == repair_by_force([r[2:] for r in rows])[6]
    assert [r.code for r in edits.orderBy("chunk", "at").collect()] and "".join(r.code for r in edits.orderBy("chunk", "at").collect()) == report.audit
