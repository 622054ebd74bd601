"""Language identification, source divergence, conversation repair."""

import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from statera.llm import conversations, divergence, language, shared

STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest_repair(turns):
    """Least cost and then least audit over all edits, by Dijkstra; turns: (role, fault)."""
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(turns) and state in (0, 3):
            return cost, audit
        put = [STEP[state, r] for r in "ua" if (state, r) in STEP]
        for t in put:
            heapq.heappush(heap, (cost + 2, audit + "I", i, t))
        if i < len(turns):
            role, fault = turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, role[:1]) in STEP:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, STEP[state, role[:1]]))
                for t in put:
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, t))


def repair_one(rows):
    """The contract for one conversation, written out: rows (conv_id, turn, role, text) as they are stored."""
    after = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        after += [(turn, role, text)] * (2 if code == 3 else 1)
    after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, turns = set(), []
    for _, role, text in after:
        body = text.strip(" \t\n\v\f\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        turns.append((role, fault))
    counts = Counter(f for _, f in turns)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    numbers = {t for t, _, _ in after if t is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, audit = cheapest_repair(turns)
    state, out, at = 0, [], iter(after)
    for edit in audit:
        role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state]
        text = ""
        if edit != "I":
            _, own, text = next(at)
            if edit == "D":
                continue
            role = own if edit == "K" else role
        state = STEP[state, role[:1]]
        out.append(f"{role}:{text}")
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def conversation_rows():
    r = random.Random(5)
    texts = ["Yes.", "No", "why?  ", "ok!\n", "", " \t", "Well. then", "x" * 3000 + ".", "é…", None]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(60) for t in range(r.randint(0, 9)) for _ in range(1 if r.random() < 0.9 else 2)]
    rows += [(1000, t, r.choice(roles[:3]), r.choice(texts[:3]) if t % 3 else f"turn {t}.") for t in range(700)]  # longer than a piece
    rows += [(1001, 5, "user", "again.")] * 300  # one turn, repeated
    rows += [(1002, t, ("user", "assistant")[t % 2], "same.") for t in range(200)]  # one text all along
    rows += [(1003, None, "user", f"q{k}?") for k in range(70)] + [(None, t, "user", "hi.") for t in (1, None, 7)] + [(1004, -(10**12), "user", "a."), (1004, 10**12, "assistant", "b.")]
    return rows + [(c, t, "user", "gone.") for c, t in itertools.product(range(2000, 2300), range(1)) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]


@pytest.fixture(params=[64, 5])
def piece_rows(request, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", request.param)
    return request.param


def test_repair_equals_brute_force(spark, tmp_path, piece_rows):
    rows = conversation_rows()
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, fault string, copies int").repartition(5)
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    found = conversations.op13_conversation_repair(spark, str(tmp_path))
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r[0]: tuple(r[1:]) for r in found.collect()}
    assert found.keys() == groups.keys()
    assert {c: repair_one(g) for c, g in groups.items()} == found


def test_repaired_turns_are_whole(spark, piece_rows):
    rows = conversation_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chunks = defaultdict(list)
    for r in conversations.repair(conversations.damaged(frame)).collect():
        chunks[r.conv_id].append(r)
    assert max(map(len, chunks.values())) > 1
    for parts in chunks.values():
        parts.sort(key=lambda r: r.chunk)
        assert [r.audit is not None for r in parts] == [False] * (len(parts) - 1) + [True]
        turns = [t for r in parts for t in r.turns]
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in turns).encode()).hexdigest() == parts[-1].sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns))


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damaged(none)).count() == 0


def test_layers_and_pieces_equal_brute_force():
    r = random.Random(2)
    fault = lambda u: "truncated" if u.isupper() else None
    for _ in range(3000):
        units = "".join(r.choice("suaxSUAXua") for _ in range(r.randint(0, 8)))
        found = conversations.layers(units, list(conversations.FINISH), 1)
        moves, state = conversations.trace(units, found, 0)
        assert (conversations.cheapest(found, 0), moves + conversations.completion(state)) == cheapest_repair([(u.lower(), fault(u)) for u in units])


def brute_audit(rows, least):
    """All numbers of the audit with Python's own integers."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        found = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = set()
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(c[t] for t in kept) for (x, s), c in groups.items() if x == lang}
        p = lambda c, n, t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept))  # noqa: B023, E731
        pairs = [(s, sum(abs(p(own, total[source], t) - p(c, total[s], t)) for t in kept)) for (x, s), c in groups.items() if x == lang and s != source]
        whole = sum((c for (x, _), c in groups.items() if x == lang), Counter())
        words = [(t, p(own, total[source], t) - p(whole, sum(total.values()), t)) for t in kept if own[t]]
        for part, items in (("pair", pairs), ("term", [w for w in words if w[1] > 0])):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, t, v, k + 1) for k, (t, v) in enumerate(ranked) if part == "pair" or k < 50}
    return out


@pytest.mark.parametrize(("tiles", "block"), [(128, 512), (2, 7), (1, 100)])
def test_audit_equals_brute_force(spark, tiles, block):
    r = random.Random(9)
    words = ["le", "Maison", "été", "Été", "x", "don't", "中文", "a1b", "ß", "zz", *(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(70))]
    rows = [(r.choice(["fr", "de", None]), r.choice(["s1", "s2", "s3", None, "é", "Z"]), " ".join(r.choice(words[: 5 + 15 * (k % 6)]) + r.choice([" ", "", "\x7f", "."]) for _ in range(r.randint(0, 30)))) for k in range(400)]
    rows += [("fr", "s1", None), ("xx", "only", "few words"), ("xx", "quiet", None), ("yy", "one", "a")] + [("fr", "s2", "copy of a text")] * 60
    rows += [("de", f"rare{k}", "w") for k in range(5)]
    frame = spark.createDataFrame([(None, *x, 1, 2) for x in rows], "doc_id long, lang string, source string, text string, n int, term int").repartition(4)
    found = divergence.audit(frame, 30, 50, block, tiles)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {tuple(x) for x in found.collect()} == brute_audit(rows, 30)
    if tiles == 128:
        assert divergence.audit(frame.limit(0)).count() == 0


def test_long_texts_are_split_between_terms(monkeypatch):
    text = "Äb1c_" + "d" * 50 + " e" * 40 + "ü"
    want = [t for part in divergence.terms(text.encode()) for t in part]
    monkeypatch.setattr(divergence, "TEXT_BYTES", 7)
    parts = list(divergence.terms(text.encode()))
    assert len(parts) > 5 and [t for part in parts for t in part] == want == re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+".encode(), text.encode().lower())
    assert list(divergence.terms(b"")) == []


def test_probabilities_are_exact():
    n = np.array([0, 5, 10**9, 10**14 + 7, 4 * 10**14])
    total = np.array([3, 5, 10**10 + 1, 9 * 10**15, 9 * 10**15])
    assert divergence.probabilities(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total)]


def tongue(seed, n):
    r = random.Random(seed)
    kind = seed % 3
    syllables = (["en", "ge", "sch", "ung", "ß"], ["la", "que", "ción", "os", "ñ"], ["th", "ing", "on", "re", "w"])[kind]
    return ("de", "es", "en")[kind], " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_kernel_is_the_blended_spectrum():
    texts = ["abcab", "bca", "", "abab" * 40, "ABC"]
    grams = [{t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)} for t in texts]
    present = np.array([language.slots(t) for t in texts], np.float32)
    assert [int(p.sum()) for p in present] == [len(g) for g in grams]  # these do not collide
    marks = np.ascontiguousarray(present.T)
    want = [[len(a & b) / max(1, len(a) * len(b)) ** 0.5 for b in grams] for a in grams]
    assert np.allclose(language.kernel(present, marks, marks.sum(0)), want)


def test_blocks_of_a_text_have_the_same_slots(monkeypatch):
    text = "".join(random.Random(1).choice("abcdefé ") for _ in range(500))
    want = language.slots(text)
    monkeypatch.setattr(language, "BLOCK_CHARS", 7)
    assert (language.slots(text) == want).all()


def test_language_held_out(spark, docs, texts, none, tmp_path):
    rows = [(k, *tongue(k, 1 + k % 40)) for k in range(900)] + [(900 + k, None, tongue(k, 20)[1]) for k in range(9)] + [(None, "en", tongue(2, 9)[1]), (5000, "en", None), (5001, "de", "12 34!"), (5002, "de", "")]
    frame = spark.createDataFrame([(i, t, g, "src", 1) for i, g, t in rows], "doc_id long, text string, lang string, source string, score int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    found = language.op11_language_kernel(spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r for r in found.collect()}
    assert len(found) == len(rows)
    held = [(found[i], g) for i, g, t in rows if i is not None and i < 900 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.lang_pred == g for r, g in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    assert [(found[i].lang_pred, found[i].score) for i in (5000, 5001, 5002)] == [("und", 0.0)] * 3
    # neither held-out languages nor the columns beside the text matter
    other = frame.withColumns({"lang": shared.F.when(language.held_out(), "xx").otherwise(shared.F.col("lang")), "source": shared.F.lit("y")})
    model = language.train(other)
    assert model.langs == ["de", "en", "es"]
    assert {r.doc_id: (r.lang_pred, round(r.score, 6)) for r in language.predict(other, model, "doc_id").collect()} == {i: (r.lang_pred, round(r.score, 6)) for i, r in found.items()}
    assert language.train(frame.where("lang IS NULL")) is None and language.train(none) is None
    assert {r.lang_pred for r in language.predict(docs, None, "doc_id").collect()} == {"und"}
    assert language.predict(docs, model, "doc_id").count() == len(texts) and language.predict(none, model, "doc_id").count() == 0


def test_model_is_ridge_regression_on_the_kernel():
    """With every row a landmark, the Nyström solution is weighted kernel ridge regression on the rows themselves."""
    rows = [tongue(k, 6) for k in range(30)]
    bits = np.array([language.slots(t) for _, t in rows])
    model = language.solve([g for g, _ in rows], bits, len(rows))
    present = bits.astype(np.float32)
    k = language.kernel(present, present.T, present.sum(1))
    index = np.array([model.langs.index(g) for g, _ in rows])
    y = (index[:, None] == np.arange(3)).astype(float)
    w = np.full(len(rows), 1 / len(rows))
    # minimise sum w (y - K a - b)^2 + ridge a'Ka
    n = len(rows)
    system = np.zeros((n + 1, n + 1))
    system[:n, :n], system[:n, n] = k @ np.diag(w) @ k + language.RIDGE * k, k @ w
    system[n, :n], system[n, n] = w @ k, 1.0
    solved = np.linalg.lstsq(system, np.vstack([k @ (w[:, None] * y), w @ y]), rcond=None)[0]
    assert np.allclose(model.scores(present), k @ solved[:n] + solved[n], atol=1e-5)
