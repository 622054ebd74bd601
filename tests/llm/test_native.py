"""Exact dedup, packing, mixing, personal data."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from statera.llm import exact_dedup, mixing, packing, personal, shared

from .conftest import DDL, SPACE, WORDS


def test_exact_dedup(spark, docs, texts, none):
    groups = defaultdict(list)
    for i, t in texts:
        groups[hashlib.sha256(SPACE.sub("", t).encode()).hexdigest()].append((i, len(t)))
    for tracked in (4096, 1):  # one tracked digest sends nearly everything through the shuffle
        found = exact_dedup.decide(shared.stored(exact_dedup.digests(docs), "t"), tracked).collect()
        assert len(found) == len(texts)
        for sha, members in groups.items():
            mine = [r for r in found if r.text_sha256 == sha]
            best = min(members, key=lambda m: (-m[1], m[0] is None, m[0]))[0]
            assert {r.keep_id for r in mine} == {best} and {r.group_size for r in mine} == {len(members)}
            assert [r.doc_id for r in mine if r.kept] == [best]
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.deduplicate(none).count() == 0


def test_bucket_bounds_are_optimal():
    import random

    r = random.Random(0)
    for _ in range(60):
        lengths = sorted(r.sample(range(1, 60), r.randint(1, 8)))
        counts = [r.randint(1, 9) for _ in lengths]
        k = r.randint(1, 5)
        cost = lambda bounds: sum(c * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts))  # noqa: B023, E731
        best = min(cost((*b, lengths[-1])) for j in range(min(k, len(lengths))) for b in itertools.combinations(lengths[:-1], j))
        found = packing.bucket_bounds(lengths, counts, k)
        assert cost(found) == best and len(found) <= k and found == sorted(found)


def test_packing(spark, docs, texts, none):
    sized = shared.stored(docs.select("doc_id", shared.n_words().alias("n_tokens")), "t")
    found = packing.pack(sized, budget=1024, buckets=4).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in found) == sorted((i is None, i, len(WORDS.findall(t))) for i, t in texts)
    batches = defaultdict(list)
    for r in found:
        assert r.padded_length >= max(r.n_tokens, 1)
        batches[r.bucket, r.batch].append(r)
    for members in batches.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        assert len(members) == 1 or sum(r.padded_length for r in members) <= 1024
    per_bucket = defaultdict(set)
    for bucket, batch in batches:
        per_bucket[bucket].add(batch)
    assert all(b == set(range(len(b))) for b in per_bucket.values())
    assert packing.pack(shared.stored(none.select("doc_id", shared.n_words().alias("n_tokens")), "t")).count() == 0


def test_mixing(spark, docs, texts, none):
    sized = shared.stored(docs.select("doc_id", "source", shared.n_words().alias("size")), "t")
    found = mixing.taken(sized, mixing.plan(sized)).collect()
    again = mixing.taken(sized, mixing.plan(sized)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again)) and len(found) == len(texts)
    total, sums, goal = sum(r.size for r in found), defaultdict(int), {}
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        sums[r.source] += r.taken
        goal[r.source] = (r.target, r.source_size)
    assert abs(sum(t for t, _ in goal.values()) - total) < 1e-6 * total
    for s, (t, size) in goal.items():
        assert t <= 3 * size and abs(sums[s] - t) <= 2
    mixed = mixing.take(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.take(none).count() == 0


def test_waterfill(spark):
    sized = spark.createDataFrame([(1, "a", 10), (2, "b", 100), (3, "c", 1000), (4, None, 0)], "doc_id long, source string, size long")
    goal = {r.source: r.target for r in mixing.targets(sized).collect()}
    # shares 1:2:3:1 of 1110; a and b stop at 30 and 300, the rest goes to c; nothing to take from the source without words
    assert goal == {"a": 30.0, "b": 300.0, "c": 780.0, None: 0.0}


def luhn(m):
    d = [int(c) for c in m if c.isdigit()]
    if not 12 <= len(d) <= 19:
        return False
    return sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(reversed(d))) % 10 == 0


BASE = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), luhn),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= sum(c.isdigit() for c in m) <= 15),
]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in p.finditer(text) if ok(m.group()))


def test_personal_base(spark, docs, texts, none):
    odd = [
        "a@b.c.d@e.f x@y@z.com", "a@b.com_x@y.zz", "1.2.3.4.5.6.7.8", "256.1.1.1 001.2.3.004", "é 4111-1111-1111-1111 é", "4111 1111 1111 1111 4111 1111 1111 1111",
        "+1+1 555 0199 22 +1 (2) 3", "+12345678 +123456789-", "a" * 5000 + "@" + "b" * 5000, "@@..@a.b", "1" * 30, "1.1.1.1@x.y", " a@b.co\U0001f600 10.0.0.1",
    ]
    frame = docs.unionByName(spark.createDataFrame([(100 + k, t, *[None] * 13) for k, t in enumerate(odd)], DDL))
    found = {(r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in personal.find(frame).collect()}
    assert found == {(i, tuple(brute(t))) for i, t in texts + [(100 + k, t) for k, t in enumerate(odd)]}
    assert personal.find(none).count() == 0


def test_personal_discovers(spark):
    seeds = [(k, f"please write to account holder user{k}@mail{k}.example.com today") for k in range(12)]
    new = [(100, "please write to account holder QX-77421-B now"), (101, "unrelated words before QX-99999-C here")]
    frame = spark.createDataFrame(seeds + new, "doc_id long, text string")
    found = {r.doc_id: [(s.start, s.end) for s in r.extra] for r in personal.find(frame).collect()}
    assert found[100] == [(31, 41)] and found[101] == [] and not any(found[k] for k in range(12))


def test_personal_discovers_in_lists_and_short_identifiers(spark):
    seeds = [(k, f"room {k} for user{k}@mail{k}.example.com today") for k in range(12)] + [(20 + k, f"id 7 then 8 user{k}@mail{k}.example.org") for k in range(12)]
    filler = "word " * 40
    new = [(100, "7 then 8 jdoe@corp"), (101, "7 then 8 A1"), (102, "7 then 8 48213 x"), (103, "12345678 87654321 2024-05-01 AB-123"), (104, "unrelated words A1"), (105, filler + "then 8 B-7")]
    frame = spark.createDataFrame(seeds + new, "doc_id long, text string")
    words = identifier_words(frame)
    assert words[103] == [("12345678", ""), ("87654321", "12345678 "), ("2024-05-01", "12345678 87654321 "), ("AB-123", "87654321 2024-05-01 ")]
    assert words[101] == [("7", ""), ("8", "7 then "), ("A1", "then 8 ")]
    found = {r.doc_id: [(s.start, s.end) for s in r.extra] for r in personal.find(frame).collect()}
    assert found[101] == [(9, 11)] and found[102] == [(9, 14)] and found[104] == [] and found[105] == [(len(filler) + 7, len(filler) + 10)]
    assert found[100] == [(9, 18)]


def identifier_words(frame):
    """doc_id: the words with a digit or an at sign, each with what stands before it, in order."""
    cuts = personal.pieces(frame)
    rows = personal.matches(cuts).where("kind = 4").join(cuts.select("row_id", "doc_id"), "row_id").orderBy("doc_id", "start").collect()
    out = defaultdict(list)
    for r in rows:
        out[r.doc_id].append((r.match, r.before))
    return out


def test_personal_context_of_long_words(spark):
    text = "a" * 200 + "  \n" + "b" * 100 + "\t1\n\n2 " + "c" * 90 + " 3"
    words = identifier_words(spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1))
    assert [w for _, w in words[1]] == ["a" * 200 + "  \n" + "b" * 100 + "\t", "b" * 100 + "\t1\n\n", "2 " + "c" * 90 + " "]


def test_personal_is_linear_in_a_text(spark):
    """A text of 100,000 numbers and one of punctuation; a walk that is quadratic would take hours."""
    rows = [(1, " ".join(str(k) for k in range(100_000))), (2, "." * 300_000 + " 1 " + "-" * 300_000 + "@"), (3, "a@b.co " * 30_000), (4, "\u0001 a@b.co\u0001 1.2.3.4")]
    found = {r.doc_id: r for r in personal.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found[3].base) == 30_000 and (found[3].base[-1].start, found[3].base[-1].end) == (29_999 * 7, 29_999 * 7 + 6)
    assert [(s.start, s.kind, s.end) for s in found[4].base] == [(2, 0, 8), (10, 1, 17)]


def brute_all(texts):
    """Base and extra spans of each text, by loops."""
    words, spans = [], [brute(t) for t in texts]
    for k, t in enumerate(texts):
        all_words = list(WORDS.finditer(t))
        for j, m in enumerate(all_words):
            if not re.search("[0-9@]", m.group()) or not re.search("[A-Za-z0-9]", m.group()):
                continue
            body = re.sub("^[^A-Za-z0-9+@]+", "", m.group())
            core = re.sub("[^A-Za-z0-9]+$", "", body)
            start = m.end() - len(body)
            end = start + len(core)
            seed = any(start <= a < end for a, _, _ in spans[k])
            if not seed and any(a < end and b > start for a, _, b in spans[k]):
                continue
            shape = re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", re.sub("[0-9]+", "0", core)))[:24]
            keys = []
            if j >= 2:
                keys.append("2 " + t[all_words[j - 2].start() : all_words[j - 1].end()].lower())
            if j >= 1:
                keys.append(f"1 {all_words[j - 1].group().lower()} {shape}")
            words.append((k, start, end, core, keys, seed))
    edges = {}
    for _, _, _, core, keys, seed in words:
        for key in keys:
            edges[key, core] = edges.get((key, core), False) or seed
    n = Counter(key for key, _ in edges)
    edges = {e: float(s) for e, s in edges.items() if n[e[0]] >= personal.LEAST_SUPPORT}
    seeds, score = {e for e, s in edges.items() if s}, dict(edges)
    for _ in range(personal.ROUNDS):
        total, support = Counter(), Counter()
        for (key, _), s in score.items():
            total[key] += s
            support[key] += s > 0.5
        grade = {key: total[key] / (n[key] + personal.SMOOTH) for key in total}
        none = defaultdict(lambda: 1.0)
        for key, core in edges:
            none[core] *= 1 - (grade[key] if support[key] >= personal.LEAST_SUPPORT else 0.0)
        score = {(key, core): 1.0 if (key, core) in seeds else 1 - none[core] for key, core in edges}
    trusted = {key for key in grade if support[key] >= personal.LEAST_SUPPORT and grade[key] >= personal.LEAST_SCORE}
    extra = [set() for _ in texts]
    for k, start, end, _, keys, seed in words:
        if not seed and trusted & set(keys):
            extra[k].add((start, 4, end))
    return spans, [sorted(x) for x in extra]


def test_personal_query(spark, tmp_path):
    """All columns of the query against loops over the same texts."""
    import random

    r = random.Random(11)
    lead = ["contact me", "reach us", "card no", "server at", "call", "ticket ref", "order", "see page"]
    texts = []
    for k in range(300):
        what = r.choice([f"user{k}@mail{k % 40}.example.com", f"10.0.{k % 250}.7", "4111 1111 1111 1111", f"+1 555 01{k:04d}", f"QX-{k}77", f"{k}", f"jdoe{k}@corp", f"({k})"])
        texts.append(" ".join(r.choice(["we", "noted,", "that", "7th"]) for _ in range(r.randint(0, 4))) + f" {r.choice(lead)} {what}{r.choice(['', '.', ' ', ' today 12'])}")
    texts += ["", None, "x" * 3000 + " 1", "4111111111111111 4111-1111-1111-1112"]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows = personal.op10_contextual_pii(spark, str(tmp_path)).collect()
    base, extra = brute_all([t or "" for t in texts])
    assert sorted(r.doc_id for r in rows) == list(range(len(texts))) and sum(map(len, extra)) > 20
    text = lambda spans: ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in spans)
    for r in rows:
        k = r.doc_id
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[1] == kind for s in base[k]) for kind in range(4))
        assert r.base_sha256 == hashlib.sha256(text(base[k]).encode()).hexdigest()
        assert r.spans == text(sorted(base[k] + extra[k]))


def test_listed(spark):
    row = spark.range(1).select(personal.listed(F.expr("array(named_struct('start', 3, 'kind', 2, 'end', 9))")).alias("x")).collect()
    assert row[0].x == "card:3:9"
