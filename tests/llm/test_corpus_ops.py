"""Training-data operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats,
empty tables and clashing extra columns."""

import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankframe.llm import chat, exact_dedup, html_text, mixing, packing, pii, quality, registry, rules, simhash, stats, token_counts, tokens
from rankframe.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD_TEXTS = [
    None, "", " ", "\n\t ", "a", "A b", "A  b", "a b c d", "İstanbul Σίσυφος ΟΔΟΣ naïve café", "été ÀÉ don't I'LL we've 12 345!!", "日本語 テキスト 🙂 emoji",
    "<|endoftext|> in <|startoftext|> text <|", "é combining", "x" * 5000, "word " * 3000, "one two three four five six one two three four five seven",
    "line\nline\n \nline x\nline x\n", "\x1c a\x1d b c", "#*$%&|<> sym|bols", "tab\tsep\x0bvt\x0cff\rcr",
]


def corpus(spark, n=120, seed=3):
    """Random prose with exact and near copies, nulls, repeated rows and columns whose names clash with ours."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(400)]
    texts = list(ODD_TEXTS)
    while len(texts) < n:
        kind = rng.random()
        if kind < 0.2:
            texts.append(rng.choice(texts))
        elif kind < 0.4 and texts[-1]:
            words = (rng.choice(texts) or "x y").split(" ")
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 200))))
    rows = [(i, t, rng.choice(["s1", "s2", "é", None]), 5, "h", 1) for i, t in enumerate(texts)]
    rows += [rows[7], rows[30]]
    schema = "doc_id long, text string, source string, size int, hash string, fp int"
    return rows, spark.createDataFrame(rows, schema).repartition(5), schema


@pytest.fixture(scope="module")
def docs(spark):
    return corpus(spark)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, size int")


# ---- 1: personal data


def brute_base(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m.group())
        if 14 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub(r"\D", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    rank = {k: i for i, k in enumerate(("email", "ip", "card", "phone"))}
    return sorted(out, key=lambda s: (s[1], rank[s[0]], s[2]))


def test_pii_base_equals_patterns():
    rng = random.Random(1)
    pieces = ["a@b.c", "@", ".", "x", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (726) 555-7857", "10.0.0.1", "256.1.1.1", "1.2.3.4.5", " ", "-", "é", "007.1.2.3", "+", "12", "(", ")", "a.b%c@d-e.f.g", "\n", "b@c@d.e"]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert pii.find(text)[0] == brute_base(text), text


def test_pii_more(spark):
    found = lambda t: [t[s:e] for _, s, e in pii.find(t)[1]]
    assert found("pay DE89 3704 0044 0532 0130 00 now") == ["DE89 3704 0044 0532 0130 00"]
    assert found("ssn 219-09-9999 ok") == ["219-09-9999"]
    assert found("call (726) 555-7857 today") == ["(726) 555-7857"]
    assert found("at 221 Baker Street, x") == ["221 Baker Street"]
    assert found("see 2001:db8::1 there") == ["2001:db8::1"]
    assert found("joe [at] mail [dot] org") == ["joe [at] mail [dot] org"]
    assert found("https://joe:pw@localhost/x") == ["joe:pw@localhost"]
    clean = "Licensed under the Apache License, Version 2.0. GNU General Public License, version 3. He was at the dot of 1999 and 2001."
    assert pii.find(clean) == ([], [])


def test_pii_more_inside_runs():
    found = lambda t: [t[s:e] for _, s, e in pii.find(t)[1]]
    assert found("built in 1998. 12 Oak Street") == ["12 Oak Street"]
    assert found("(12 Oak Street)") == ["12 Oak Street"] and found("version 2.0 Oak Street") == []
    assert found("see 2001:db8:0:0:1:2:3:abcd there at 12:30:45") == ["2001:db8:0:0:1:2:3:abcd"]
    name, hosts = "n" * 120, " [dot] ".join(["part"] * 40)
    assert found(f"write {name} [at] {hosts}, please") == [f"{name} [at] {hosts}"]
    assert found("a [at] b [dot] com.x [at] y [dot] org") == ["a [at] b [dot] com", ".x [at] y [dot] org"]
    began = time.time()
    for text in ("a" * 400_000 + " dot ", "a dot " * 60_000, "joe [at] mail [dot] org, " * 20_000, "1 2. (3) " * 60_000, "ab:" * 130_000):
        pii.find(text)
    assert time.time() - began < 30


def test_pii_cues_in_any_usual_case():
    found = lambda t: [t[s:e] for _, s, e in pii.find(t)[1]]
    assert found("Tax ID: 12345678") == ["12345678"] and found("Social Security number 123456789") == ["123456789"]
    assert found("Passport No. X1234567") == ["X1234567"] and found("ACCOUNT NUMBER 99 1234 5678") == ["99 1234 5678"]
    assert found('x token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" y') == ["04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    assert found('TOKEN = "9233A8ECF7C5B09F"!! API_KEY: abc123def456ghi.') == ["9233A8ECF7C5B09F", "abc123def456ghi"]
    assert found("the token: something-without-digits and a secret = 123456789012345 of token 5") == []


def test_pii_long_texts_take_linear_time():
    began = time.time()
    for run in ("1" * 1_000_000, "1." * 500_000, "12.34.5 " * 120_000, "+1 " * 300_000, "token = " * 120_000, "token=" + "a1" * 500_000, "+1" + "(" * 1_000_000, "://" * 300_000):
        pii.find(run)
    assert pii.find(":" * 400_000) == ([], [])
    many = "a@b.c " * 30_000 + "(726) 555-7857, " * 30_000
    base, more = pii.find(many)
    assert len(base) == len(more) == 30_000
    assert time.time() - began < 30


def test_pii_query(spark, docs):
    rows, df, _ = docs
    out = pii.op1_pii(df).collect()
    assert len(out) == len(rows)
    by = dict((r[0], r[1] or "") for r in rows)
    for r in out:
        assert r["base_sha256"] == pii.digest_of(brute_base(by[r["doc_id"]]))
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
        assert len(spans) == r["n_spans"] and set(spans) >= set(brute_base(by[r["doc_id"]]))
        assert sorted(spans, key=lambda x: (x[1], pii.KINDS.index(x[0]))) == spans and all(0 <= a < b <= len(by[r["doc_id"]]) for _, a, b in spans)
    assert pii.op1_pii(empty(spark)).count() == 0


# ---- 2: packing


def test_word_encoder_equals_library():
    encoder = tokens.WordEncoder(entries=50)
    rng = random.Random(2)
    texts = [t for t in ODD_TEXTS if t] + ["".join(rng.choices(["a", "É", "'s", "'", "9", " ", "!", "\n", "ß", "~", "don't", "×", "÷", "µ", "ª", "²", "½", "the"], k=20)) for _ in range(800)]
    for t in texts:
        assert np.frombuffer(encoder.encode(t), "<u2").tolist() == encoder.library.encode(t, add_special_tokens=False).ids, t


def test_packing_round_trip(spark, docs):
    rows, df, _ = docs
    window = 64
    encoder = tokens.WordEncoder()
    ids = {r[0]: np.frombuffer(encoder.encode(r[1] or ""), "<u2").tolist() + [1] for r in rows}
    pieces = packing.pack(df, window=window).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        part = ids[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["ids_crc32"] == zlib.crc32(np.array(part, "<u4")) and p["doc_tokens"] == len(ids[p["doc_id"]])
        by_doc.setdefault(p["doc_id"], []).extend(range(p["start"], p["start"] + p["length"]))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    copies = Counter(r[0] for r in rows)
    assert {d: sorted(v) for d, v in by_doc.items()} == {d: sorted(list(range(len(ids[d]))) * copies[d]) for d in copies}
    last = max(by_sequence)
    assert set(by_sequence) == set(range(last + 1))
    for number, parts in by_sequence.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end == window or number == last
    assert packing.pack(empty(spark)).count() == 0


# ---- 3: chat


def test_chat_links(spark):
    call = lambda i, name, args: f'<tool_call>{{"id":"{i}","name":"{name}","arguments":{args}}}</tool_call>'
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "let me " + call("a", "search", '{"query":"x","limit":3}') + call("b", "search", '{"limit":"3"}')),
        (1, 3, "tool", '{"tool_call_id":"b","content":[2,1]}'), (1, 2, "tool", '{"tool_call_id":"a","content":{"z":1,"b":"é"}}'),
        (1, 4, "assistant", call("a", "search", '{"query":"again"}') + call("c", "nope", "{}") + "<tool_call>broken</tool_call>"),
        (1, 5, "tool", '{"tool_call_id":"zzz","content":null}'), (2, 0, None, None), (2, 0, None, None), (2, 1, "tool", "plain words"),
    ]
    out = chat.link(spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, json int"))
    rows = out.orderBy("conv_id", "order_turn", "order_place", "order_kind", "turn").collect()
    one = [(r["kind"], r["call_id"], r["status"]) for r in rows if r["conv_id"] == 1]
    assert one == [
        ("message", None, "plain"), ("message", None, "plain"), ("call", "a", "valid"), ("result", "a", "linked"), ("call", "b", "invalid: missing query"), ("result", "b", "linked"),
        ("message", None, "plain"), ("call", "a", "duplicate"), ("call", "c", "invalid: unknown tool"), ("result", "zzz", "orphan"),
    ]
    assert [r["message"] for r in rows if r["call_id"] == "a" and r["kind"] == "call"][0] == '{"arguments":"{\\"limit\\":3,\\"query\\":\\"x\\"}","id":"a","name":"search"}'
    assert sum(r["conv_id"] == 2 for r in rows) == 3
    assert not [n for n in ("Python", "Arrow") if n in out._jdf.queryExecution().executedPlan().toString()]
    assert chat.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- 4 and 6: models


def junk(rng, words):
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in words) if kind == 1 else " | ".join(words)


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(vocabulary, k=rng.randint(12, 120))
        bad = rng.random() < 0.25
        rows.append((i, junk(rng, words) if bad else " ".join(words).capitalize() + ".", "en", "src"))
        if i % 2:
            labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows + [(9001, None, None, None), (9002, "", "en", "s")], "doc_id long, text string, lang string, source string")
    return docs, spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, quality int"), dict(labels)


def test_quality_held_out(spark, judged):
    docs, labels, truth = judged
    out = {r["doc_id"]: r for r in quality.op4_quality(docs, labels).collect()}
    assert len(out) == 902 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out.values())
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in out.items())
    held = [d for d in truth if out[d]["held_out"]]
    assert np.mean([out[d]["predicted"] == truth[d] for d in held]) > 0.97
    kept = quality.accepted(docs, quality.train(docs, labels))
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in out.items() if r["predicted"]}
    assert quality.score_documents(docs, quality.train(docs, labels.limit(0))).where("abs(score - 0.5) < 1e-9").count() == 902
    assert quality.op4_quality(docs.limit(0), labels).count() == 0


def test_quality_model_against_its_definition(spark, judged):
    """Scores by the formula, one document at a time; the weights as the minimum of the pairwise loss; the threshold as the best cut."""
    docs, labels, truth = judged
    x, y = quality.labelled_features(docs, labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    fold = lambda d: zlib.crc32(str(d).encode()) % 5
    assert sorted(map(tuple, x.tolist())) == sorted(tuple(map(float, stats.features(texts[d].encode()))) for d in truth if fold(d))
    model = quality.fit(x, y, pairs=3000)
    scaled = lambda v: [min(8.0, max(-8.0, (a - c) / s)) for a, c, s in zip(v, model.centre, model.spread)]
    worth = lambda v: math.fsum(a * w for a, w in zip(scaled(v), model.weights))
    for r in quality.score_documents(docs, model).collect()[:200]:
        z = worth(stats.features(texts[r["doc_id"]].encode())) - model.threshold + math.log(0.3 / 0.7)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    rng = np.random.default_rng(quality.SEED)
    good, bad = (np.array([scaled(v) for v in x[y == k]]) for k in (1, 0))
    d = good[rng.integers(0, len(good), 3000)] - bad[rng.integers(0, len(bad), 3000)]
    loss = lambda w: np.mean(np.logaddexp(0, -d @ w)) + quality.RIDGE * w @ w / 2
    at = loss(model.weights)
    for i in range(len(model.weights)):
        for step in (-0.05, 0.05):
            assert loss(model.weights + step * np.eye(len(model.weights))[i]) > at
    worths = np.array([worth(v) for v in x])
    errors = lambda cut: np.mean(worths[y == 1] < cut) + np.mean(worths[y == 0] >= cut)
    assert errors(model.threshold) <= min(errors(c) for c in worths) + 1 / min((y == 0).sum(), (y == 1).sum())


def test_samples_keep_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {i} of one id") for i in range(500)] + [(2, "another text"), (6, "x"), (None, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (6, None), (None, 1)], "doc_id long, quality int")
    x, y = quality.labelled_features(docs, labels)
    want = [d for d in (1, 2) if zlib.crc32(str(d).encode()) % 5]
    assert len(x) == len(y) == len(want)


def walked(forest, row):
    total = forest.start
    for at in forest.roots:
        while forest.feature[at] >= 0:
            at = forest.left[at] if row[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return total


@pytest.mark.parametrize("depth, trees", [(1, 3), (3, 8), (6, 5)])
def test_forest_margins_of_any_depth(depth, trees):
    rng = np.random.default_rng(depth)
    x = rng.random((600, len(stats.FEATURES)))
    y = ((x[:, 0] * 3 + np.sin(9 * x[:, 1]) - x[:, 4] + rng.normal(0, 0.3, 600)) > 1).astype(int)
    forest = rules.fit(x, y, trees=trees, depth=depth)
    fresh = rng.random((200, len(stats.FEATURES)))
    assert np.allclose(forest.margin(fresh), [walked(forest, row) for row in fresh], atol=1e-12)
    # Each tree lowers the weighted log loss of what it was grown on.
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum()) * len(y)
    losses = [np.mean(share * np.logaddexp(0, np.where(y == 1, -1, 1) * rules.fit(x, y, trees=n, depth=depth).margin(x))) for n in range(1, trees + 1)]
    assert all(b < a for a, b in zip(losses, losses[1:]))


def brute_counts(text):
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(grams)
    covered = {j for i, g in enumerate(grams) if often[g] > 1 for j in range(i, i + 5)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_rules(spark, judged, docs):
    rows, df, _ = docs
    forest = rules.train(*judged[:2])
    by = {r[0]: r[1] or "" for r in rows}
    out = rules.judge(df, forest).collect()
    assert len(out) == len(rows)
    for r in out:
        n = brute_counts(by[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["kept"] and r["base_failed"])
    x = np.random.default_rng(0).random((300, len(stats.FEATURES))) * 2
    for name in stats.DECREASING:
        more = x.copy()
        more[:, stats.FEATURES.index(name)] += 0.5
        assert (forest.margin(more) <= forest.margin(x) + 1e-12).all(), name
    truth = judged[2]
    held = [r for r in rules.judge(judged[0], forest).collect() if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == bool(truth[r["doc_id"]]) for r in held]) > 0.97
    assert rules.judge(empty(spark), forest).count() == 0


def test_chat_keeps_malformed_calls_as_text(spark):
    good, bad, open_ = '<tool_call>{"id":"a","name":"search","arguments":{"query":"x"}}</tool_call>', "<tool_call>{broken</tool_call>", "<tool_call>{"
    texts = [f"see {bad} ok", f"{good}see {bad}{good} ok {open_}", f"{open_}\n{good} then {good} end", bad, good, "", " kept  as it is \n"]
    want = [f"see {bad} ok", f"see {bad} ok {open_}", f"{open_}\n{good} then  end", bad, "", "", " kept  as it is \n"]
    turns = spark.createDataFrame([(i, 0, "assistant", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    rows = chat.link(turns).collect()
    assert [json.loads(r["message"])["content"] for r in sorted(rows, key=lambda r: r["conv_id"]) if r["kind"] == "message"] == want
    assert sorted(r["conv_id"] for r in rows if r["kind"] == "call") == [1, 1, 2, 4]


def brute_chat(turns):
    """What linking gives, turn by turn and call by call: kind, call_id, status, order and message of each row."""
    kinds = {"string": str, "integer": int, "number": (int, float)}
    canonical = lambda x: json.dumps(x, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    calls, first, rows = {}, {}, []

    def load(raw):
        try:
            return json.loads(raw)
        except ValueError:
            return None

    def problem(call):
        name, given = call.get("name"), call.get("arguments")
        if name is None:
            return "no name"
        if name not in chat.TOOLS:
            return "unknown tool"
        if not isinstance(given, dict):
            return "arguments"
        required, optional = chat.TOOLS[name]
        for key in required:
            if key not in given:
                return f"missing {key}"
        for key, kind in {**required, **optional}.items():
            if key in given and not (isinstance(given[key], kinds[kind]) and not isinstance(given[key], bool)):
                return f"type of {key}"
        more = sorted(set(given) - {*required, *optional})
        return f"unknown {more[0]}" if more else None

    for number, (conv, turn, role, text) in enumerate(turns):
        blocks = re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text or "") if role == "assistant" else []
        calls[number] = [(place, load(raw)) for place, raw in enumerate(blocks)]
        for place, call in calls[number]:
            if call and call.get("id") is not None:
                key = conv, call["id"]
                first[key] = min(first.get(key, (turn, place, call["name"])), (turn, place, call["name"]))
    for number, (conv, turn, role, text) in enumerate(turns):
        body = load(text or "") if role == "tool" else None
        result_of = body.get("tool_call_id") if isinstance(body, dict) else None
        if result_of is not None:
            call = first.get((conv, result_of))
            said = {"content": canonical(body.get("content")), "role": role, "tool_call_id": result_of} | ({"name": call[2]} if call else {})
            place = (call[0], call[1], 2) if call else (turn, -1, 0)
            rows.append((conv, turn, "result", result_of, "linked" if call else "orphan", *place, canonical(said)))
            continue
        parts = iter(calls[number])
        text = re.sub(r"(?s)<tool_call>(.*?)</tool_call>", lambda m: m.group() if next(parts)[1] is None else "", text or "") if role == "assistant" else text or ""
        rows.append((conv, turn, "message", None, "plain", turn, -1, 0, canonical({"content": text, "role": role or ""})))
        for place, call in calls[number]:
            if call is not None:
                wrong, call_id = problem(call), call.get("id")
                status = f"invalid: {wrong}" if wrong else "no id" if call_id is None else "valid" if first[conv, call_id][:2] == (turn, place) else "duplicate"
                said = {"arguments": canonical(call.get("arguments")), "name": call.get("name")} | ({"id": call_id} if call_id is not None else {})
                rows.append((conv, turn, "call", call_id, status, turn, place, 1, canonical(said)))
    return rows


def test_chat_equals_brute_force(spark):
    """Orphans, duplicates, results before calls, malformed calls, every kind of fault, long texts, and one identifier very often."""
    rng = random.Random(12)
    arguments = ['{"limit":3,"query":"é \\\\ \\" q"}', '{"limit":"3","query":"x"}', '{"limit":3}', '{"expression":"1+1"}', "{}", '{"url":"u","timeout":1.5}', '{"url":7}', '{"code":"x","more":[1,{"a":null}]}', "[1]", '{"query":true}']
    turns = []
    for conv in range(40):
        for turn in range(rng.randint(1, 9)):
            blocks = []
            for _ in range(rng.randint(0, 3)):
                head = rng.choice(['"id":"a",', '"id":"b",', f'"id":"c{turn}",', ""])
                good = f'{{{head}"name":"{rng.choice(["search", "calculator", "fetch", "python", "nope"])}","arguments":{rng.choice(arguments)}}}'
                blocks.append(f"<tool_call>{good if rng.random() < 0.8 else rng.choice(['{broken', '', good[:-1]])}</tool_call>")
            result = json.dumps({"tool_call_id": rng.choice(["a", "b", f"c{turn}", f"c{turn + 2}", "zzz"]), "content": rng.choice([None, "é", {"z": [1, "2"], "b": {}}])}, ensure_ascii=False)
            role = rng.choice(["user", "assistant", "assistant", "tool", None])
            text = {"assistant": " ".join(["hi ", *blocks, " bye"]), "tool": rng.choice([result, result, "plain", "{"])}.get(role, rng.choice([None, "", "words", *blocks]))
            turns.append((conv, turn, role, text))
    turns += [turns[3], (99, 0, "assistant", '<tool_call>{"id":"a","name":"search","arguments":{"query":"' + "x" * 300_000 + '"}}</tool_call>' + " y" * 200_000)]
    turns += [(99, i, "tool", '{"tool_call_id":"a","content":%d}' % i) for i in range(1, 500)]
    out = chat.link(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    got = [(r["conv_id"], r["turn"], r["kind"], r["call_id"], r["status"], r["order_turn"], r["order_place"], r["order_kind"], r["message"]) for r in out]
    # Arguments and content are canonical JSON inside JSON: the same bytes in both.
    assert Counter(got) == Counter(brute_chat(turns))


@pytest.mark.parametrize("name", ["op3_chat", "op3_chat_calls"])
def test_chat_queries_equal_their_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    rows = registry.QUERIES[name](spark, folder)
    columns = sorted(rows.columns)
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = connection.sql(registry.ORACLES[name])
    assert Counter(map(tuple, rows.select(*columns).collect())) == Counter(tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall())


# ---- 5: simhash


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, linked):
    parent = {k: k for k in items}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    items = list(items)
    for i, a in enumerate(items):
        for b in items[:i]:
            if linked(a, b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in items}


def test_simhash(spark, docs):
    rows, df, _ = docs
    by = {r[0]: brute_fingerprint(r[1]) for r in rows}
    want = brute_components(by, lambda a, b: (by[a] ^ by[b]).bit_count() <= 2)
    out = simhash.op5_simhash(df).collect()
    assert len(out) == len(rows)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in out} == {d: (f"{by[d]:016x}", want[d]) for d in by}
    assert simhash.op5_simhash(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [2, 3, 1000])
def test_near_links_keep_every_link(spark, hot):
    rng = random.Random(hot)
    points = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(points)[:6]:
        for _ in range(40):
            points.add(centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    edges = simhash.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot)
    got = {r["node"]: r["root"] for r in connected_components(edges).collect()}
    mask = (1 << 64) - 1
    assert all(((r["a"] ^ r["b"]) & mask).bit_count() <= 2 for r in edges.collect())
    want = brute_components(signed, lambda a, b: ((a ^ b) & mask).bit_count() <= 2)
    assert {p: got.get(p, p) for p in signed} == want


def shingles(text, k=5):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def similar(a, b):
    return a == b or 10 * len(a & b) >= 8 * len(a | b)


def edited(rng, words, share):
    """A copy with a share of words changed one by one, a block left out, or words added at an end."""
    words, kind = list(words), rng.randrange(3)
    if kind == 0:
        for _ in range(max(1, int(len(words) * share / 10))):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    elif kind == 1:
        at = rng.randrange(len(words))
        del words[at : at + int(len(words) * share)]
    else:
        words += [f"y{rng.randrange(10**6)}" for _ in range(int(len(words) * share))]
    return words


@pytest.mark.parametrize("hot", [1, 2, 32])
def test_similar_documents_equal_brute_force(spark, hot):
    rng = random.Random(6)
    texts = [t for t in ODD_TEXTS] + ["  ", "Word " * 3000]
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 7, 12, 30, 80, 300, 1500]))]
        texts.append(" ".join(words))
        for _ in range(rng.randrange(4)):
            words = edited(rng, words, rng.choice([0.02, 0.1, 0.2, 0.4])) or ["z"]
            texts.append(" ".join(words))
    rows = [(i, t, "b") for i, t in enumerate(texts)] + [(0, texts[0], "b"), (25, texts[25], "b")]
    out = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(3), hot=hot).collect()
    assert len(out) == len(rows)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = brute_components(sets, lambda a, b: similar(sets[a], sets[b]))
    roots = {}
    for r in out:
        assert roots.setdefault(r["doc_id"], r["root"]) == r["root"]
    classes = {}
    for i, root in roots.items():
        classes.setdefault(root, []).append(i)
    assert sorted(map(sorted, classes.values())) == sorted(sorted(i for i in want if want[i] == c) for c in set(want.values()))
    assert simhash.similar_documents(empty(spark)).count() == 0


def test_similar_documents_of_a_crowd(spark):
    """Many copies of one text, each edited in its own way: like the text itself, unlike each other; and documents that
    share a long passage and nothing else."""
    rng = random.Random(10)
    origin = [f"w{rng.randrange(10**5)}" for _ in range(200)]
    rows = [(5000, " ".join(origin))]
    for i in range(600):
        words = list(origin)
        for at in rng.sample(range(5, 195), 3):
            words[at] = f"x{i}x{at}"
        rows.append((i, " ".join(words)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(6000 + i, " ".join(f"q{i}q{j}" for j in range(40)) + " " + passage) for i in range(300)]
    out = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    roots = {r["doc_id"]: r["root"] for r in out}
    sets = {d: shingles(t) for d, t in rows}
    alike = [d for d in range(600) if similar(sets[d], sets[5000])]
    assert len(alike) > 400 and all(roots[d] == roots[5000] for d in alike)
    assert len({roots[6000 + i] for i in range(300)}) == 300


@pytest.mark.parametrize("hot", [1, 8, 32])
def test_similar_documents_within_a_shared_passage(spark, hot):
    """Texts of several lengths that share one passage, among them pairs, chains and a class of near copies: every link
    is found, and the passage alone links nothing."""
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(120):
        own = [f"q{i}q{j}" for j in range(rng.choice([8, 14, 20, 40, 90]))]
        texts.append(own + passage if i % 2 else passage + own)
        for _ in range(rng.choice([0, 0, 1, 2])):
            texts.append(edited(rng, texts[-1], rng.choice([0.02, 0.05, 0.1])))
    texts += [edited(rng, texts[0], 0.03) for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    out = simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), hot=hot).collect()
    sets = {d: shingles(t) for d, t in rows}
    want = brute_components(sets, lambda a, b: similar(sets[a], sets[b]))
    assert len(set(want.values())) < 130
    classes = {}
    for r in out:
        classes.setdefault(r["root"], []).append(r["doc_id"])
    assert sorted(map(sorted, classes.values())) == sorted(sorted(i for i in want if want[i] == c) for c in set(want.values()))


def test_components_of_chains(spark):
    rng = random.Random(9)
    order = list(range(300))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199)] + [(order[200 + i], order[200]) for i in range(100)] + [(order[0], order[1]), (5, 5)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(order[:200]) for n in order[:200]} | {n: min(order[200:]) for n in order[200:]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 7: mixing


def brute_mix(rows):
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in rows}
    totals = Counter()
    for r in rows:
        totals[r[2]] += size[r[0]]
    names = sorted((s for s in totals if s is not None), key=lambda s: s) + [None] * (None in totals)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    budget, target, open_ = 1.5 * sum(totals.values()), dict.fromkeys(names, 0.0), set(names)
    left = budget
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * totals[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        open_ -= full
    return size, totals, target


def test_mixing(spark, docs):
    rows, df, schema = docs
    size, totals, target = brute_mix(rows)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    taken = Counter()
    for r in out:
        s = r["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[s] and math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in totals:
        hashes = sorted((int(hashlib.md5(f"{r[0]}|{r[1] or ''}".encode()).hexdigest()[:15], 16), size[r[0]]) for r in rows if r[2] == s)
        passes = int(target[s] // totals[s]) if totals[s] else 0
        rest, upto, more = target[s] - passes * totals[s], 0, 0
        for h in sorted({h for h, _ in hashes}):
            upto += sum(n for x, n in hashes if x == h)
            more = upto if upto <= rest + 1e-9 else more
        assert taken[s] == passes * totals[s] + more
    mixed = mixing.mixed_rows(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)
    assert mixing.op7_mixing(empty(spark)).count() == 0


def test_mixing_splits_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else 7, f"w{i} " * (i % 9 + 1), "a" if i % 2 else "b") for i in range(4000)] + [(1, "x " * 30_000, "c")]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    sums = {r["source"]: (r["t"], r["target"]) for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target")).collect()}
    assert all(abs(sums[s][0] - sums[s][1]) <= 9 for s in "ab")


# ---- 8: exact dedup


def weak_digest(sha):
    return F.substring(sha, 1, 1)


@pytest.mark.parametrize("digest", [exact_dedup.whole, weak_digest])
def test_exact_dedup(spark, docs, digest):
    rows, df, _ = docs
    norm = {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows}
    groups, least = Counter(norm[r[0]] for r in rows), {}
    for d, t in norm.items():
        least[t] = min(d, least.get(t, d))
    out = exact_dedup.exact_duplicates(df, digest).collect()
    assert len(out) == len(rows)
    for r in out:
        t = norm[r["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (least[t], groups[t], r["doc_id"] == least[t], hashlib.sha256(t.encode()).hexdigest())


@pytest.mark.parametrize("digest", [exact_dedup.whole, weak_digest])
@pytest.mark.parametrize("from_files", [True, False])
def test_exact_dedup_of_increments(spark, docs, tmp_path, digest, from_files):
    """Later documents meet the retained state: each call's rows against brute force over all rows so far."""
    rows, _, schema = docs
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    random.Random(8).shuffle(rows := list(rows))
    seen, state = [], f"file://{tmp_path}/state"
    for i, part in enumerate((rows[:50], rows[50:60], rows[50:60], rows[60:], [])):
        frame = spark.createDataFrame(part, schema).repartition(2)
        if from_files:
            frame.write.mode("overwrite").parquet(f"file://{tmp_path}/in{i}")
            frame = spark.read.parquet(f"file://{tmp_path}/in{i}")
        # The third call repeats the second by name: its rows count once.
        name = f"part{1 if i == 2 else i}"
        if i == 2:
            frame = frame if not from_files else spark.read.parquet(f"file://{tmp_path}/in1")
        else:
            seen += part
        groups, least = Counter(norm(r[1]) for r in seen), {}
        for r in seen:
            least[norm(r[1])] = min(r[0], least.get(norm(r[1]), r[0]))
        got = exact_dedup.exact_duplicates(frame, digest, state=state, increment=name, files_per_batch=1).collect()
        text = {r[0]: norm(r[1]) for r in part}
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == sorted(
            (r[0], least[text[r[0]]], groups[text[r[0]]], r[0] == least[text[r[0]]]) for r in part
        )


def test_exact_dedup_is_native_and_empty(spark, docs):
    plan = exact_dedup.op8_exact_dedup(docs[1])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert exact_dedup.op8_exact_dedup(empty(spark)).count() == 0


# ---- 9: pages

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a>About us</a></li></ul></nav>'
    '<div class="ad">Buy this now please</div><article><h1>{title}</h1><p><b>Bold {title}<br><p>One &amp; two&nbsp;three {a}</p><div class="cookie-notice">We use cookies</div>'
    '<p>Second   paragraph\n here {b}</p><form><input>Subscribe <button>go</button></form></article><aside>Side words</aside><section id="comments"><p>Nice post, thanks a lot for it</p></section>'
    "<footer>&copy; x &middot; foot</footer></body></html>"
)


def page_rows():
    return [(i, f"u{i}", PAGE.format(title=f"Title {i}", a="words " * (i % 7 + 1), b="more " * (i % 5 + 1))) for i in range(60)]


def test_pages(spark):
    odd = [(100, None, None), (101, "u", ""), (102, "u", "no tags & at all"), (103, "u", PAGE.format(title="Cut", a="aa " * 30, b="bb")[:700]), (0, "u0", page_rows()[0][2])]
    df = spark.createDataFrame([(*r, "x") for r in page_rows() + odd], "page_id long, url string, html string, text string")
    out = html_text.extract(df).collect()
    assert len(out) == 65
    by = {r["page_id"]: r for r in out}
    for i in range(60):
        a, b = ("words " * (i % 7 + 1)).strip(), ("more " * (i % 5 + 1)).strip()
        assert by[i]["text"] == f"Title {i}\n\nBold Title {i}\n\nOne & two three {a}\n\nSecond paragraph here {b}"
        assert by[i]["n_chars"] == len(by[i]["text"])
    assert by[100]["text"] == by[101]["text"] == "" and by[102]["text"] == "no tags & at all" and "aa aa" in by[103]["text"]
    assert html_text.extract(df.limit(0)).count() == 0


def test_class_names_inside_articles():
    """Inside a marked article only whole names that mean nothing else are left out; elsewhere other whole names are too."""
    w, v = "w " * 40, "v " * 40
    body = f'<p class="more">{w}</p><div class="notice-of-death">{v}</div><div class="cookie-notice">We use</div><div class="ad">Buy</div><div id="ad-banner">Buy</div><form>x</form>'
    kept = f"{w.strip()}\n\n{v.strip()}"
    assert html_text.main_text(f"<nav>Menu</nav><article>{body}</article><footer>foot</footer>", {}) == kept
    assert html_text.main_text(f"<body><p>{w}</p><div class=\"more\">x</div><div class='side-notes-of-mine'>{v}</div></body>", {}) == kept


def test_pages_take_linear_time():
    runs = {
        "<div>" * 100_000 + "</p>" * 100_000, "<div>" * 8000 + "</p>" * 8000, "<b>" * 340_000 + "x", "<a>x" * 100_000, "<!--" * 250_000, '<a "' * 250_000, "<a '\">" * 160_000, "<" * 500_000,
        "<li>x" * 100_000, "<p><div>" * 60_000 + "</p></div>" * 60_000, '<p class="' + "more " * 100_000 + '">x',
    }
    began = time.time()
    for html in runs:
        html_text.main_text(html, {})
    assert time.time() - began < 40


MATTER = set("p h1 h2 h3 ul li table tr td blockquote div section article main".split()) | {"b", "br", "a", "i"}


def score_of(kind, key, weights, inside):
    tag = key.lstrip("/").split(">")[0]
    word = kind == html_text.WORD
    own = (0.25 if key.endswith(">a") else 1.0) if word else -0.25 if tag in MATTER else -1.0
    score = weights.get(("w " if word else "t ") + key, own)
    return max(score, own) if inside else score


def best_blocks(html, weights):
    """The blocks of the best contiguous region, by trying all of them; the earliest end of the best sum, its shortest start."""
    rows, sums = [], [0.0]
    for kind, key, text, boiler, inside in html_text.events(html):
        n = len(text.split()) if kind == html_text.WORD else 1
        rows.append((kind, text, boiler, inside))
        sums.append(sums[-1] + n * ((0.0 if inside else -0.5) if boiler else score_of(kind, key, weights, inside)))
    spans = [(sums[j] - sums[i], -j, i) for i in range(len(rows)) for j in range(i + 1, len(rows) + 1)]
    best = max(spans, default=(0, 0, 0))
    if best[0] <= 1e-12:
        return ""
    low, high = best[2], -best[1]
    if any(r[3] for r in rows[low:high]):
        low = max((i + 1 for i in range(low) if not rows[i][3]), default=0) if rows[low][3] else low
        high = min((i for i in range(high, len(rows)) if not rows[i][3]), default=len(rows)) if rows[high - 1][3] else high
    while low > 0 and rows[low - 1][0] != html_text.BREAK:
        low -= 1
    while high < len(rows) and rows[high][0] != html_text.BREAK:
        high += 1
    blocks, part = [], ""
    for kind, text, boiler, _ in [*rows[low:high], (html_text.BREAK, "", False, False)]:
        if kind == html_text.BREAK:
            blocks.append(" ".join(part.split()))
            part = ""
        elif not boiler:
            part += text
    return "\n\n".join(b for b in blocks if b)


def test_best_region_equals_brute_force():
    rng = random.Random(14)
    pieces = ["<p>a b</p>", "<li>c</li>", "<td>", "d e f", "<div>g</div>", "</td>", "<b>h</b> i", "<nav>j k</nav>", '<div class="ad">l</div>', "<br>", "m &amp; n", "</div>", "<div>", "<article>", "</article>"]
    for _ in range(600):
        html = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12)))
        weights = {k: rng.randint(-16, 16) / 8 for k in ("w p", "w li", "w td", "w div", "w body", "t p", "t /p", "t li", "t /li", "t td", "t /td", "t div", "t /div", "t b", "t br")}  # sums are exact
        assert html_text.main_text(html, weights) == best_blocks(html, weights), html


PARAGRAPH = "<p>" + "Some words of the matter stand here in a row. " * 4 + "</p>"
INSIDE = {
    "list at the end": (PARAGRAPH + "<ul><li>one thing</li><li>two <b>things</b></li></ul>", ["one thing", "two things"]), "list at the start": ("<ul><li>one thing</li></ul>" + PARAGRAPH, ["one thing"]),
    "a link as last paragraph": (PARAGRAPH + '<p><a href="x">see the last link here</a></p>', ["see the last link here"]), "a last div": (PARAGRAPH + "<div>last block in a div</div>", ["last block in a div"]),
    "a last table": (PARAGRAPH + "<table><tr><th>head</th><td>cell &lt;a&gt;</td></tr><tr><td>cell b</td></tr></table>", ["head", "cell <a>", "cell b"]),
    "divs alone": ("<div>first block of words</div><div>second block of words</div>", ["first block of words", "second block of words"]),
    "a title and items": ("<h1>Title</h1><ul>" + "".join(f"<li>item number {k}</li>" for k in range(10)) + "</ul>", ["Title", *(f"item number {k}" for k in range(10))]),
    "quotes and definitions": (PARAGRAPH + "<blockquote>a quote</blockquote><dl><dt>term</dt><dd>its meaning</dd></dl><pre>x = 1</pre>", ["a quote", "term", "its meaning", "x = 1"]),
}
AWAY = "comment-list post-comments comments-section site-header page-footer main-nav left-sidebar ad-slot related-posts share-buttons".split()


class Blocks(HTMLParser):
    """Another parser: the blocks of what it is fed."""

    def __init__(self):
        super().__init__()
        self.blocks = [""]

    def handle_starttag(self, tag, attrs):
        self.blocks += [""] if tag not in ("a", "b") else []

    handle_endtag = lambda self, tag: self.handle_starttag(tag, ())

    def handle_data(self, data):
        self.blocks[-1] += data


def learned(spark):
    return html_text.learn_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"))


def test_whole_articles_are_kept(spark):
    """All kinds of blocks at the ends of an article, marked or not, with weights of a table whose articles hold none of them."""
    weights = learned(spark)
    for name, (body, blocks) in INSIDE.items():
        parser = Blocks()
        parser.feed(body)
        want = "\n\n".join(" ".join(b.split()) for b in parser.blocks if b.strip())
        assert all(b in want.split("\n\n") for b in blocks)
        for around in ("article", "div", "main"):
            page = f"<html><head><title>t</title></head><body><nav><ul><li>menu</li></ul></nav><{around}>{body}</{around}><footer>foot words</footer></body></html>"
            assert html_text.main_text(page, weights) == want, (name, around)


def test_named_parts_are_left_out(spark):
    weights = learned(spark)
    aside = lambda name: f'<div class="x {name}"><p>UNWANTED words stand here</p></div>'
    for name in AWAY:
        for page in (PARAGRAPH + aside(name) + PARAGRAPH, PARAGRAPH + aside(name), f"<article>{PARAGRAPH}</article>" + aside(name)):
            assert "UNWANTED" not in html_text.main_text(f"<body>{page}</body>", weights), name
        inside = html_text.main_text(f"<body><article>{PARAGRAPH}{aside(name)}{PARAGRAPH}</article></body>", weights)
        assert ("UNWANTED" in inside) == (name not in ("comment-list", "post-comments", "comments-section", "ad-slot")), name
    for name in ("notice-of-death", "entry-header", "no-sidebar", "post-footer", "ad-free"):
        assert "UNWANTED" in html_text.main_text(f"<body>{PARAGRAPH}{aside(name)}{PARAGRAPH}</body>", weights), name


def test_pages_of_the_table_equal_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    unmarked = html_text.extract(pages.withColumn("html", F.regexp_replace("html", r"<(/?)article\b", "<$1div")), learned(spark))
    both = html_text.extract(pages).join(unmarked.select("page_id", F.col("text").alias("other")), "page_id")
    assert both.where("text <> other OR text = ''").count() == 0 and both.count() == pages.count()


# ---- further inputs of calls, kept state and labelled numbers


def test_calls_lose_nothing(spark):
    said = [
        (1, 0, "assistant", "a<tool_call>5</tool_call>b<tool_call>null</tool_call><tool_call>[1]</tool_call>c"),
        (1, 1, "assistant", '<tool_call>{"name":"search","id":"k","arguments":{"query":"q"},"z":{"b":1,"a":[null]},"more":2}</tool_call>'),
        (1, 2, "tool", '{"tool_call_id":"k","content":"r","extra":5,"name":"n"}'), (1, 3, "tool", "7"), (2, 0, "assistant", "w " * 200_000 + "<tool_call>{}</tool_call>"), (3, 0, None, None),
    ]
    rows = chat.op3_chat(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")).collect()
    at = {(r["conv_id"], r["turn"], r["kind"]): r["message"] for r in rows}
    assert at[1, 0, "message"] == '{"content":"a<tool_call>5</tool_call>b<tool_call>null</tool_call><tool_call>[1]</tool_call>c","role":"assistant"}' and (1, 0, "call") not in at
    assert at[1, 1, "call"] == '{"arguments":"{\\"query\\":\\"q\\"}","id":"k","more":{"more":2,"z":{"a":[null],"b":1}},"name":"search"}'
    assert at[1, 2, "result"] == '{"content":"\\"r\\"","more":{"extra":5,"name":"n"},"name":"search","role":"tool","tool_call_id":"k"}'
    assert at[1, 3, "message"] == '{"content":"7","role":"tool"}' and len(at[2, 0, "message"]) > 400_000 and (2, 0, "call") in at and len(rows) == 8


@pytest.mark.parametrize("digest", [exact_dedup.whole, weak_digest])
def test_increments_of_made_columns(spark, tmp_path, digest):
    """Ids and texts that are computed from renamed columns of files, differently in each call."""
    state, seen = f"file://{tmp_path}/state", []
    for i, (rows, make) in enumerate([
        ([(4, "One  TEXT", 0), (5, "two", 0)], lambda df: df.select(F.col("key").alias("doc_id"), F.lower("body").alias("text"))),
        ([(1, "one", 0), (7, None, 0)], lambda df: df.select((F.col("key") + 1).alias("doc_id"), F.concat("body", F.lit("\ttext")).alias("text"))),
        ([(3, "one text", 1), (9, "TWO", 1)], lambda df: df.where("other = 1").select((F.col("key") - 2).alias("doc_id"), F.lower("body").alias("text"), "other")),
    ]):
        spark.createDataFrame(rows, "key long, body string, other int").coalesce(1).write.parquet(f"file://{tmp_path}/in{i}")
        made = make(spark.read.parquet(f"file://{tmp_path}/in{i}"))
        own = [(r["doc_id"], " ".join(re.split(r"[\x20\x09-\x0D]+", r["text"] or ""))) for r in made.collect()]
        seen += own
        got = exact_dedup.exact_duplicates(made, digest, state=state, increment=f"call{i}").collect()
        want = [(d, min(x for x, u in seen if u == t), sum(u == t for _, u in seen)) for d, t in own]
        assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == sorted(want)


def test_labelled_numbers_of_any_length():
    spans = lambda text: [text[a:b] for kind, a, b in pii.find(text)[1] if kind == "account"]
    long = "1234567890AB" * 4
    assert spans(f"account: {long}, x") == [long] and spans("account: " + "1234 5678 " * 6 + "end") == [("1234 5678 " * 6).strip()]
    assert spans("tax ID is 12-3456789.") == ["12-3456789"] and spans("account_number=12345678") == ["12345678"]
    assert spans("iban: gb29 nwbk 6016 1331 9268 19") == ["gb29 nwbk 6016 1331 9268 19"] and spans("iban gb29nwbk60161331926818") == []
    assert spans("account 12345678 WAS CLOSED") == ["12345678"] and spans("account 12345 and 678901") == []
    began = time.time()
    for text in ("ACCOUNT 1 " * 20_000, "ACCOUNT 1  " * 20_000, "SSN 1 " * 40_000, "account " + "1A" * 100_000, "iban gb29 " * 20_000, "account " + "A" * 200_000):
        pii.find(text)
    assert time.time() - began < 20


# ---- 10: token counts


def test_token_counts(spark, docs, tmp_path):
    rows, df, _ = docs
    library = tokens._load("byte_bpe_50k.json")
    cache = f"file://{tmp_path}/cache"
    want = {r[0]: (len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False))) for r in rows}
    for part in (df.where("doc_id < 40"), df, df):
        out = token_counts.count_tokens(part, cache).collect()
        assert all((r["n_bytes"], r["n_tokens"]) == want[r["doc_id"]] and r["over_limit"] == (r["n_tokens"] > 512) for r in out)
    assert len(out) == len(rows)
    # Warm: nothing is left to encode, and what is encoded next is not shuffled.
    text = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("digest", token_counts.content_digest(F.col("text")))
    known = spark.read.parquet(cache)
    missing = token_counts.missing_counts(text.drop("text"), known)
    assert missing.count() == 0
    plan = token_counts._to_encode(text, text.drop("text"), missing)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan.split("BroadcastExchange")[0]
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in rows})
    assert token_counts.count_tokens(empty(spark)).count() == 0
