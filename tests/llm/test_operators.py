"""Operators against brute force on small tables with nulls, empty texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from bindery.llm import langid, licenses, mixing, packing, pivots, sharding, simhash, suffixes, urlfilter, vectors
from bindery.llm.common import in_blocks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, whole string, before long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _rows():
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefgé") for _ in range(rnd.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = text(40)
    rows = [[i, text(rnd.randint(5, 120)), rnd.choice(["en", "fr"]), rnd.choice(["a", "b", "é"])] for i in range(40)]
    rows += [[40, None, "en", None], [41, "", None, "a"], [42, "...", "fr", "b"], [43, rows[3][1], "en", "a"]]
    rows += [[44, rows[3][1], "en", "a"], [44, rows[3][1], "en", "a"], [None, rows[5][1], "en", "b"]]
    rows += [[45 + i, f"{text(8)} {passage} {text(6)}", "en", "b"] for i in range(5)]
    rows += [[60, rows[7][1] + " " + "ab " * 400 + text(30_000), "fr", None], [61, "one two", "en", "c"]]
    return [(*r, None, 7, "x", 1) for r in rows]


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _all(df):
    return [r.asDict() for r in df.collect()]


def test_mixture_meets_each_target_and_caps(docs):
    got = _all(mixing.mixture(docs))
    assert len(got) == len(ROWS)
    sizes: dict = {}
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORDS.findall(r[1] or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in order if s not in capped)
        rest = total - sum(3 * sizes[s] for s in capped)
        new = {s for s in order if s not in capped and weight[s] * rest / free > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    for s in order:
        mine = [r for r in got if r["source"] == s]
        want = 3 * sizes[s] if s in capped else weight[s] * rest / free
        assert mine[0]["target"] == pytest.approx(want)
        assert sum(r["taken"] for r in mine) == int(mine[0]["target"] + 1e-9)
        assert all(r["taken"] <= 3 * r["size"] for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, _all(mixing.mixture(docs.repartition(3)))))


def test_draw_takes_what_the_mixture_says(docs):
    drawn = _all(mixing.draw(docs))
    taken = {}
    for r in drawn:
        assert len(WORDS.findall(r["text"])) == r["take"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["take"]
    for r in _all(mixing.mixture(docs).groupBy("source").sum("taken")):
        # repeated rows at the cut are all cut there
        assert taken.get(r["source"], 0) == pytest.approx(r["sum(taken)"], abs=150)


def test_packing_round_trip(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    got = _all(packing.pack(docs))
    want = []
    for r in ROWS:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((r[0] or -1, k // 4096, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    keys = ("piece", "start", "length", "ids_crc32")
    assert sorted(want) == sorted((r["doc_id"] or -1, *(r[k] for k in keys)) for r in got)
    for s in {r["sequence_id"] for r in got}:
        at = 0
        for r in sorted((r for r in got if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    n_tokens = sum(w[3] for w in want)
    assert len({r["sequence_id"] for r in got}) <= -(-n_tokens // 4096) + 1
    whole = _all(packing.sequences(docs))
    assert sum(len(r["ids"]) for r in whole) == n_tokens and all(len(r["ids"]) == sum(r["lengths"]) for r in whole)


def _encoded(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_words_with_signs_do_not_need_the_whole_tokenizer(monkeypatch):
    texts = ["Ver.*** asíll### Enè it,&&& ", "", " \t", "ÉTÉ <<b>> (c) ***", "plain\nwords"]
    want = _encoded(texts)
    words = packing._Words(packing.default_tokenizer())
    whole, sent = words._whole, []
    monkeypatch.setattr(words, "_whole", lambda some: sent.extend(some) or whole(some))
    assert list(words.ids(pa.array(texts))) == want
    # no word of letters and signs behind them is sent there
    assert sorted(sent) == ["(c)", "<<b>>"]


def test_ids_of_odd_texts(monkeypatch):
    odd = ["it's I'LL a' 's ...'", "x<|endoftext|>y <|startoftext|>", "İstanbul J\u030c e\u0301 \u212a", "a\x1cb c\x1f", "1234 \u0661",
           "A" * 300 + "!", "a" * 65 + " " + "é" * 64 + ".", "." * 300, "a\u2028b\u3000c\x85d\xa0e", "a>\u0338 \u0301b", "</w> a</w>"]
    texts = [*odd, " ".join(odd), *odd[::-1]]
    words = packing._Words(packing.default_tokenizer())
    assert list(words.ids(pa.array(texts))) == _encoded(texts)
    # what is remembered or forgotten, and parts that the model does not tell apart, change nothing
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(words, "_parts", lambda parts: None)
    for text, ids in zip(texts, _encoded(texts), strict=True):
        assert list(words.ids(pa.array([text]))) == [ids]


def test_plan_prefers_exact_sums():
    for times, parts in packing.plan({6: 2, 4: 2, 5: 2, 8: 1, 2: 1}, 10):
        assert times * sum(a * n for a, n in parts) == times * 10


def test_language_mixture(spark, empty):
    rnd = random.Random(1)
    make = lambda syl, n: " ".join("".join(rnd.choice(syl) for _ in range(3)) for _ in range(n))
    a, b = ["the", "ing", "and", "sh"], ["ção", "lho", "que", "os"]
    rows = [(i, make(a if i % 2 else b, 60), "en" if i % 2 else "pt", "s", 0, 1, "", 0) for i in range(120)]
    rows += [(200, None, "en", None, 0, 1, "", 0), (201, "12 .", None, None, 0, 1, "", 0)]
    rows += [(202, make(a, 90) + " " + make(b, 60), None, None, 0, 1, "", 0), (203, make(a, 900_000), None, "s", 0, 1, "", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    languages, model = langid.train(docs)
    assert languages == ["en", "pt"]
    got = {r["doc_id"]: r for r in _all(langid.predict(docs, languages, model, ["doc_id", "shard"]))}
    assert all(got[r[0]]["lang_pred"] == r[2] for r in rows[:120])
    assert [got[i]["lang_pred"] for i in (200, 201)] == ["und", "und"] and got[200]["score"] == 0
    assert got[202]["languages"]["en"] == pytest.approx(0.6, abs=0.1) and got[203]["lang_pred"] == "en"
    none = langid.predict(docs, *langid.train(empty), ["doc_id"])
    assert {r["lang_pred"] for r in _all(none)} == {"und"}
    assert langid.predict(empty, languages, model, ["doc_id"]).count() == 0


def _plain_em(counts, p, among, steps=langid.STEPS):
    """Proportions and log-likelihood of ``{bucket: n}``, one language and one trigram after the other."""
    theta = {k: 1 / len(among) for k in among}
    total = sum(counts.values())
    for _ in range(steps if len(among) > 1 else 0):
        new = dict.fromkeys(among, 0.0)
        for b, n in counts.items():
            whole = sum(theta[k] * p[b, k] for k in among)
            for k in among:
                new[k] += n * theta[k] * p[b, k] / whole
        theta = {k: v / total for k, v in new.items()}
    return theta, sum(n * math.log(sum(theta[k] * p[b, k] for k in among)) for b, n in counts.items())


def test_mixture_inference_against_plain_em():
    rnd = random.Random(7)
    syllables = [["the", "ing", "and"], ["ção", "lho", "que"], ["sch", "ung", "ein"], ["eau", "oui", "ais"], ["szy", "prz", "nie"]]
    make = lambda k, n: " ".join("".join(rnd.choice(syllables[k]) for _ in range(3)) for _ in range(n))
    p = np.full((langid.BUCKETS, 5), langid.SMOOTHING)
    for k in range(5):
        _, bucket, n = langid._counts([make(k, 4000)])
        p[bucket, k] += n
    p = (p / p.sum(0)).astype(np.float32)
    texts = [make(0, 50), " ".join(make(k, 80) for k in range(5)), make(1, 100) + " " + make(3, 40), "", "qq"]
    texts += [" ".join(make(k, 60) for k in range(4)), make(2, 5)]
    got = langid.infer(texts, p)
    for row, text in zip(got, texts, strict=True):
        codes = langid._codes(" " + text + " ")
        counts = {}
        for b in langid._buckets(codes).tolist():
            counts[b] = counts.get(b, 0) + 1
        if not counts:
            assert not row.any()
            continue
        theta, _ = _plain_em(counts, p, range(5))
        order, best, want = sorted(range(5), key=lambda k: -theta[k]), -math.inf, {}
        for size in range(1, 6):
            few, fit = _plain_em(counts, p, order[:size])
            value = fit - (size - 1) * langid.PENALTY * math.log(sum(counts.values()))
            if value <= best:
                break
            best, want = value, few
        assert np.allclose(row, [want.get(k, 0.0) for k in range(5)], atol=2e-3)
    # five languages in equal parts give five proportions
    assert (got[1] > 0.15).all() and (got[0] > 0).sum() == 1 and (got[5] > 0.2).sum() == 4


def test_languages_of_a_batch_of_long_texts_stay_small():
    """What a slice of a batch takes does not grow with the batch."""
    import tracemalloc

    import pyarrow as pa

    from bindery.llm.common import slices

    text = "the quick brown fox " * 120
    batch = pa.RecordBatch.from_pydict({"text": [text] * 10_000})
    p = np.full((langid.BUCKETS, 4), 1 / langid.BUCKETS, np.float32)
    tracemalloc.start()
    for part in slices(iter([batch]), "text"):
        langid.infer(part.column(0).to_pylist(), p)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert batch.nbytes > 20 << 20 and peak < 160 << 20


def test_predictions_beside_columns_of_their_names(spark):
    docs = spark.createDataFrame([(1, "the the the", "en", 5)], "doc_id long, text string, lang string, score int")
    languages, p = langid.train(docs)
    with pytest.raises(ValueError):
        langid.predict(docs, languages, p, docs.columns)
    got = langid.predict(docs, languages, p, docs.columns, ("pred", "score_", "shares")).first()
    assert got["score"] == 5 and got["pred"] in ("en", "und")


def _gone(rows):
    first = {}
    for i, text in ((r[0], (r[1] or "").encode()) for r in rows):
        if i is not None:
            for k in range(len(text) - 49):
                first[text[k : k + 50]] = min(first.get(text[k : k + 50], i), i)
    for i, text in ((r[0], (r[1] or "").encode()) for r in rows):
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - 49) if i is not None else ():
            if first[text[k : k + 50]] < i:
                gone[k : k + 50] = True
        yield i, text, gone


def test_repeats_equal_brute_force(docs):
    want = []
    for i, text, gone in _gone(ROWS):
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((i, len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in suffixes.repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(w[2] for w in want)


def test_remove_repeats_keeps_columns_and_characters(docs):
    got = _all(suffixes.remove_repeats(docs.withColumn("repeated", docs.doc_id)))
    assert all(r["whole"] == "x" and r["repeated"] == r["doc_id"] for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[43]["text"] == "" and by_id[40]["text"] is None and by_id[None]["text"] == ROWS[5][1]
    assert by_id[0]["text"] == ROWS[0][1] and by_id[0]["shard"] == 7
    assert len(got) == len(ROWS)


def test_parse_in_stretches(monkeypatch):
    rnd = random.Random(9)
    data = bytes(rnd.choice(b"ab ") for _ in range(5_000))
    whole = {x for _, p in suffixes.parses(data) for x in p.strings(np.arange(p.last[-1] + 1)).tolist()}
    monkeypatch.setattr(suffixes, "STRETCH", 512)
    assert whole == {x for _, p in suffixes.parses(data) for x in p.strings(np.arange(p.last[-1] + 1)).tolist()}


def test_shards_are_even_and_gapless(docs):
    got = _all(sharding.shuffle_shards(docs, 7, bucket_bytes=4096))
    assert len(got) == len(ROWS)
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(7)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    odd = docs.withColumns({"_order": docs.n_chars, "_pos": docs.lang})
    assert sharding.shuffle_shards(odd, 7).columns == [*(c for c in odd.columns if c != "shard"), "slot", "shard", "bucket"]
    again = _all(sharding.shuffle_shards(docs.repartition(2), 7, bucket_bytes=4096))
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_fingerprints_of_edited_texts(docs):
    got = _all(simhash.edited_fingerprints(docs, every=10))
    assert len(got) == len(ROWS)
    ids = sorted({r[0] for r in ROWS if r[0] is not None})
    text = {r[0]: r[1] or "" for r in ROWS}
    fp = {r["doc_id"]: r["fingerprint"] for r in got}
    for r in got:
        mine = text[r["doc_id"]]
        assert r["n_chars"] == len(mine)
        if r["doc_id"] is not None:
            after = ids[(ids.index(r["doc_id"]) + 1) % len(ids)]
            q = len(mine) // 4
            edited = mine[: len(mine) - q] + text[after][:q]
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            differ = bin(int(r["fingerprint"], 16) ^ int(fp[after], 16)).count("1")
            assert r["near_next"] == 1 - differ / 64
        if r["doc_id"] is not None and r["doc_id"] % 10 == 0:
            near = sum(bin(int(r["fingerprint"], 16) ^ int(x["fingerprint"], 16)).count("1") <= 3 for x in got)
            assert r["n_near"] == near - 1
    assert fp[3] == fp[43] == fp[44] and fp[40] == fp[41] == "0" * 16


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    rows = [(i, base[i % 60] + (0.15 * rng.standard_normal(16) if i >= 60 else 0), i % 60 % 3) for i in range(180)]
    rows = [(i, [float(np.float32(x)) for x in v], label, 1) for i, v, label in rows]
    rows += [(200, rows[4][1], rows[4][2], 1), (201, rows[4][1], rows[4][2], 1), (202, rows[4][1], None, 1)]
    rows += [(203, None, 1, 1), (204, [0.0] * 16, 1, 1), (205, [float("nan")] * 16, 1, 1), (206, [1.0] * 8, 1, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep int")
    got = {r["vec_id"]: r for r in _all(vectors.near_duplicates(df))}
    assert len(got) == len(rows)
    good = [r for r in rows if r[2] is not None and r[1] and np.isfinite(r[1]).all() and any(r[1]) and len(r[1]) == 16]
    x = np.array([r[1] for r in good])
    cos = x @ x.T / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1)[None]
    label = np.array([r[2] for r in good])
    near = (cos >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    found = sum(got[r[0]]["n_links"] for r in good)
    assert all(got[r[0]]["n_links"] <= n for r, n in zip(good, near.sum(1), strict=True))
    assert found >= 0.95 * near.sum() > 0
    assert got[201]["component_id"] == got[4]["component_id"] and not got[201]["kept"]
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i for i in (202, 203, 204, 205, 206))
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_a_large_label_takes_no_links_from_small_ones(spark, monkeypatch):
    width, least = vectors.calibrate(0.93, vectors.LINES, vectors.RECALL)
    p = 0.6826894921370859
    counted = sum(math.comb(24, k) * p**k * (1 - p) ** (24 - k) for k in range(least, 25))
    for n in (vectors.CELL + 1, 1_000_000, 1_000_000_000):
        bits, rounds = vectors.cells(n, 0.93, vectors.SHARED)
        assert counted * (1 - (1 - (1 - math.acos(0.93) / math.pi) ** bits) ** rounds) >= vectors.RECALL
    rng = np.random.default_rng(12)
    base = rng.standard_normal((100, 16))
    near = [base[i % 100] * 1.0 + 0.28 * rng.standard_normal(16) for i in range(400)]
    small = [(i, [float(np.float32(x)) for x in v], i % 4 + 1) for i, v in enumerate(near)]
    large = [(1000 + i, [float(x) for x in rng.standard_normal(16).astype(np.float32)], 0) for i in range(1500)]
    monkeypatch.setattr(vectors, "CELL", 128)
    schema = "vec_id long, embedding array<float>, label int"
    alone = sorted(map(tuple, vectors.near_duplicates(spark.createDataFrame(small, schema)).collect()))
    beside = vectors.near_duplicates(spark.createDataFrame(small + large, schema)).filter("vec_id < 1000")
    assert alone == sorted(map(tuple, beside.collect())) and sum(r[1] for r in alone) > 100


def test_license_phrases_and_labels(spark, empty):
    texts = ["Released Under the MIT-License; under the mit license!", None, "", "CC BY NC cc by nc by nc", "the mit"]
    texts += ["x This work is licensed under the GNU General Public License, version 3 y", "general public license"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r["doc_id"]: r for r in _all(licenses.scan(df))}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (2, 1, 5, "mit")
    assert (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (2, 0, 3)
    assert got[5]["labels"] == "gpl-3" and got[5]["base_labels"] == "" and got[5]["score"] > 0.9
    assert all(got[i]["labels"] == "" and got[i]["first_word"] is None for i in (1, 2, 4, 6))
    assert licenses.scan(empty).count() == 0


def test_every_notice_of_a_long_file_is_found(spark):
    notices = [notice for notice, _ in licenses.TEMPLATES.values()]
    scattered = sorted({w for n in notices for w in n.split()})
    texts = [" . filler words stand here . ".join(notices)]
    texts += [" x ".join(scattered) + " x " + n + " x " + " x ".join(reversed(scattered)) for n in notices]
    texts += [f"permission is hereby granted free of charge {n}" for n in notices] + ["common gnu general public license"] * 90
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: set(r["labels"].split(",")) for r in _all(licenses.scan(df))}
    labels = list(licenses.TEMPLATES)
    assert got[0] == set(labels)
    assert all(label in got[1 + i] and label in got[1 + len(labels) + i] for i, label in enumerate(labels))


def _scanned(words, templates, weight):
    """Labels by trying every template at every start."""
    found = {}
    for label, (notice, keys) in templates.items():
        n, keys = notice.split(), [k.split() for k in keys]
        total = sum(weight[w] for w in n)
        places = [next(i for i in range(len(n)) if n[i : i + len(k)] == k) for k in keys]
        for start in range(-len(n) + 1, len(words)):
            inside = sum(weight[w] for i, w in enumerate(n) if 0 <= start + i < len(words) and words[start + i] == w)
            there = all(words[start + i : start + i + len(k)] == k for k, i in zip(keys, places) if start + i >= 0)
            if inside >= licenses.MATCH * total and there:
                found[label] = max(found.get(label, 0), min(1.0, inside / total))
    return found


def test_license_labels_against_every_start_of_every_template(spark):
    rnd = random.Random(3)
    notices = list(licenses.TEMPLATES.values())
    common = [w for n, _ in notices for w in n.split()]
    texts = ["and use in source and binary forms with or without modification are permitted"]
    texts += [texts[0] + " under the mit license"]
    for n, _ in notices:
        words = n.split()
        for _ in range(4):
            some = words[rnd.randrange(len(words) // 2) :] if rnd.random() < 0.5 else words[: rnd.randint(1, len(words))]
            some = [w if rnd.random() > 0.1 else rnd.choice(common) for w in some]
            before = [rnd.choice(common) for _ in range(rnd.choice([0, 0, 7]))]
            texts.append(" ".join([*before, *some, *(rnd.choice(common) for _ in range(10))]))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    templates = licenses.TEMPLATES
    index = licenses._Index(templates, *licenses.document_frequency(df, sorted(set(common))))
    got = {r["doc_id"]: r for r in _all(licenses.scan(df))}
    base = [(p.split(), label) for p, label in licenses.BASE.items()]
    for i, t in enumerate(texts):
        words = t.split()
        hits = [(at, label) for p, label in base for at in range(len(words)) if words[at : at + len(p)] == p]
        want = _scanned(words, templates, index.weight)
        assert got[i]["labels"] == ",".join(sorted({*want, *(label for _, label in hits)})), t
        assert got[i]["n_base"] == len(hits)
        assert got[i]["score"] == pytest.approx(1.0 if hits else max(want.values(), default=0.0))
    assert got[0]["labels"] == "bsd-3" and got[1]["labels"] == "bsd-3,mit"


def test_pivot_groups_equal_brute_force(docs):
    got = _all(pivots.near_duplicates(docs))
    want = {}
    for r in ROWS:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        words = WORDS.findall(words)
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want[r[0]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert all(r["fp"][0] % (1 << 64) == want[r["doc_id"]] for r in got) and len(got) == len(ROWS)
    group = {f: f for f in want.values()}
    for _ in group:
        for a in group:
            for b in group:
                if (a ^ b).bit_count() <= 2:
                    group[a] = group[b] = min(group[a], group[b])
    least = {}
    for i, f in want.items():
        if i is not None:
            least[group[f]] = min(i, least.get(group[f], i))
    assert all(r["component_id"] == least[group[want[r["doc_id"]]]] for r in got)


def test_pivot_tables_miss_no_close_pair(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 400, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 63, (400, 2)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, base ^ flips[:, 0] ^ flips[:, 1]]))
    rows = [(i, [int(f)]) for i, f in enumerate(fps.tolist())]
    df = spark.createDataFrame(rows, "id long, fp array<long>")
    found = {frozenset((r["a"], r["b"])) for r in _all(pivots.links(df, 2, 1))}
    want = {frozenset(p) for a in range(len(fps)) for p in [(a, int(b)) for b in np.flatnonzero(np.bitwise_count(fps ^ fps[a]) <= 2) if b != a]}
    assert found == want and len(want) > 300


def test_a_large_group_of_near_fingerprints_gives_few_links(spark):
    rng = np.random.default_rng(8)
    bits = np.tile(rng.integers(0, 2, 256, np.uint8), (600, 1))
    for row in bits:  # one large group within the radius of its centre, others far from all
        row[rng.choice(256, 12, replace=False)] ^= 1
    bits = np.vstack([bits, rng.integers(0, 2, (200, 256), np.uint8)])
    fps = np.packbits(bits, axis=1).view(np.int64)
    df = spark.createDataFrame([(i, f.tolist()) for i, f in enumerate(fps)], "id long, fp array<long>")
    found = [(r["a"], r["b"]) for r in _all(pivots.links(df, 38, 4, 50))]
    assert _groups(range(800), found) == _groups(range(800), [(0, i) for i in range(1, 600)])
    assert len(found) < 800


def _groups(nodes, edges):
    """The smallest node that each node is connected with."""
    least = {i: i for i in nodes}
    for _ in range(len(least)):
        was = dict(least)
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
        if least == was:
            return least
    return least


def test_keep_first_keeps_one_near_copy(docs, spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(2_000)]
    base = [rnd.choice(words) for _ in range(400)]
    copy = [*base[:100], "new", *base[101:]]
    other = [rnd.choice(words) for _ in range(400)]
    rows = [(i, " ".join(w), "en", "s", 0, 1, "", 0) for i, w in ((5, base), (2, copy), (9, base), (7, other), (2, copy))]
    kept = pivots.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["doc_id"] for r in _all(kept)) == [2, 7] and kept.columns == docs.columns


def test_keep_first_takes_every_pair_from_the_similarity_on(spark):
    rnd = random.Random(21)
    rows, want = [], set()
    for at, similarity in enumerate((0.75, 0.8, 0.85, 0.9)):
        for i in range(60):
            # 2n / (1 + similarity) shingles each, of which the first n are shared
            shared, own = round(300 * 2 * similarity / (1 + similarity)), round(300 * (1 - similarity) / (1 + similarity))
            head = [f"{rnd.getrandbits(40):x}" for _ in range(shared + 4)]
            pair = [head + [f"{rnd.getrandbits(40):x}" for _ in range(own)] for _ in range(2)]
            a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in pair)
            near = len(a & b) / len(a | b) >= 0.8
            ids = [1000 * at + 2 * i, 1000 * at + 2 * i + 1]
            rows += [(x, " ".join(w), "en", "s", 0, 1, "", 0) for x, w in zip(ids, pair, strict=True)]
            want |= {ids[0]} if near else set(ids)
    got = [r["doc_id"] for r in _all(pivots.keep_first(spark.createDataFrame(rows, SCHEMA)))]
    # no clean document is dropped; of 180 pairs to find at most one in fifty is lost
    assert want <= set(got) and len(got) - len(want) <= 3 and 300 <= len(want) <= 330


@pytest.mark.parametrize("texts", [4, 1024])
def test_similar_texts_of_large_components_against_every_pair(spark, monkeypatch, texts):
    """Leaders, rounds and blocks connect what brute force connects, chains and rows at the edge included."""
    monkeypatch.setattr(pivots, "TEXTS", texts)
    rnd = random.Random(31)
    word = lambda: f"{rnd.getrandbits(40):x}"
    rows = []
    for component, clusters in ((0, 3), (1, 1), (2, 0)):
        for _ in range(clusters):
            base = [word() for _ in range(100)]
            rows += [(component, [*base[:at], word(), *base[at + 1 :]]) for at in range(10, 60, 5)]
            # a chain that leaves the first text step by step
            rows += [(component, base[k:] + [f"{component}-{i}" for i in range(k)]) for k in range(0, 60, 6)]
        rows += [(component, [word() for _ in range(80)]) for _ in range(8)]
    rows.append((2, []))
    rnd.shuffle(rows)
    table = [(c, i, [0], " ".join(w) or None) for i, (c, w) in enumerate(rows)]
    df = spark.createDataFrame(table, "component long, id long, fp array<long>, text string")
    sets = [set(pivots._shingle_set(t, 5).tolist()) for *_, t in table]

    def labels(edges):
        label = list(range(len(table)))
        for a, b in edges:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
        return label

    pairs = [(a, b) for a in range(len(table)) for b in range(a) if table[a][0] == table[b][0]]
    want = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    got = [(r["a"], r["b"]) for r in _all(pivots.similar(df, 5, 0.8, 64))]
    assert labels(got) == labels(want) and len(set(labels(want))) < len(table) - 40


def test_a_large_group_of_near_copies_moves_each_text_a_few_times(spark, monkeypatch):
    monkeypatch.setattr(pivots, "TEXTS", 16)
    dealt = []
    monkeypatch.setattr(pivots, "in_blocks", lambda rows, *a: dealt.append(rows.count()) or in_blocks(rows, *a))
    rnd = random.Random(32)
    base = [f"{rnd.getrandbits(40):x}" for _ in range(200)]
    table = [(0, i, [0], " ".join([*base[: 20 + i % 90], f"n{i}", *base[21 + i % 90 :]])) for i in range(400)]
    found = pivots.similar(spark.createDataFrame(table, "component long, id long, fp array<long>, text string"), 5, 0.8, 64)
    # one leader settles all: nothing is left to compare in blocks
    assert {(r["a"], r["b"]) for r in _all(found)} == {(i, 0) for i in range(1, 400)} and dealt == [0]


def test_keep_first_keeps_unlike_texts_under_one_doc_id(spark):
    rnd = random.Random(22)
    text = lambda: " ".join(f"{rnd.getrandbits(40):x}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (None, c), (7, c + " x"), (3, d), (3, e), (3, e), (None, None), (None, "")]
    rows += [(9, "ha " * 400 + a[:400]), (10, "ha " * 400 + b[:400])]
    df = spark.createDataFrame([(i, t, "en", "s", 0, 1, "", 0) for i, t in rows], SCHEMA)
    got = sorted(str((r["doc_id"], (r["text"] or "")[:460])) for r in _all(pivots.keep_first(df)))
    want = [(None, a), (None, b), (7, c + " x"), (3, d), (3, e), (None, ""), *rows[-2:]]
    assert got == sorted(str((i, t[:460])) for i, t in want)


def test_fingerprints_without_an_id_link_others(spark, monkeypatch):
    fps = {0: 0, 1: 0b11, 2: 0b1111, 3: 1 << 40, 4: 7 << 50}
    fake = lambda docs, size, words: spark.createDataFrame(
        [(5, [fps[0]]), (None, [fps[1]]), (9, [fps[2]]), (None, [fps[4]])], "doc_id long, fp array<long>"
    )
    monkeypatch.setattr(pivots, "fingerprints", fake)
    got = {r["fp"][0]: r["component_id"] for r in _all(pivots.near_duplicates(None))}
    assert got == {0: 5, 0b11: 5, 0b1111: 5, 7 << 50: None}


def test_url_rules(spark, empty):
    urls = ["http://A.Example.NET/en/1?x", "https://x.example.net/de/", "http://example.com/de/a#b", "ftp://x.org/fr/1"]
    urls += [None, "nothing", "http://net", "http://m.cheap-pills.example.org/fr/x", "http://m.free-bets.example.com/en/", "x://y.org?://n.net/a"]
    df = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, rule int")
    got = {r["page_id"]: r for r in _all(urlfilter.judge(df))}
    rules = ["example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, "org/fr/", None, None]
    assert [got[i]["rule"] for i in range(len(urls))] == rules
    assert [got[i]["verdict"] for i in range(len(urls))] == ["allow", "block", "block", "allow", "allow", "allow", "allow", "allow", "block", "allow"]
    assert got[0]["host"] == "a.example.net" and got[0]["path"] == "/en/1" and got[9]["host"] == "y.org"
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    universe = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    listed = spark.range(0, 20_000, 7).select(F.xxhash64("id").alias("h"))
    levels = urlfilter.cascade(universe, listed)
    h = np.array([r["h"] for r in universe.collect()])
    assert len(levels) > 1 and (urlfilter.member(h, levels) == (np.arange(20_000) % 7 == 0)).all()


def test_cascade_in_parts(spark):
    from pyspark.sql import functions as F

    universe = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    h = np.array([r["h"] for r in universe.collect()])
    for step in (1, 7, 9_000, 20_001):  # all, many, fewer than parts, one
        listed = spark.range(0, 20_000, step).select(F.xxhash64("id").alias("h"))
        levels = urlfilter.cascade(universe, listed, part_keys=900)
        assert (urlfilter.member(h, levels) == (np.arange(20_000) % step == 0)).all()
    none = urlfilter.cascade(universe, universe.limit(0), part_keys=900)
    assert not urlfilter.member(h, none).any()


def test_url_filter_by_brute_force_with_and_without_sent_filters(spark):
    rnd = random.Random(10)
    labels = ["net", "org", "com", "example", "spam-farm", "a", "b", "cheap-pills"]
    hot = "http://x.example.net/en/1"
    urls = [f"http://{'.'.join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))}/{rnd.choice(['en', 'de', 'fr'])}/x" for _ in range(600)]
    urls += [hot] * 400 + [None, "", "no url", "http:///en/", "http://.net"]
    df = spark.createDataFrame([(i % 900, u) for i, u in enumerate(urls)], "page_id long, url string").repartition(4)

    def expected(page_id, url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            host = re.split("[/?#]", rest)[0].lower()
            path = re.split("[?#]", rest[len(host):])[0]
        parts = host.split(".")
        suffixes = [".".join(parts[i:]) for i in range(len(parts))] if host else []
        fits = [r for r in urlfilter.RULES if r[: r.index("/")] in suffixes and path.startswith(r[r.index("/") :])]
        rule = max(fits, key=lambda r: (len(r), r.index("/")), default=None)
        listed = any(set(s.split(".")) & set(urlfilter.BLOCKED_LABELS) for s in suffixes)
        return page_id, host, path, rule, urlfilter.RULES[rule] if rule else "block" if listed else "allow", listed

    want = sorted((expected(i % 900, u) for i, u in enumerate(urls)), key=str)
    for tuning in ({}, {"part_keys": 40}, {"part_keys": 40, "sent_bytes": 0, "task_keys": 50}, {"sent_bytes": 0}):
        assert sorted((tuple(r) for r in urlfilter.judge(df, **tuning).collect()), key=str) == want
    bare = urlfilter.judge(df, rules={}, blocked_labels=(), sent_bytes=-1)
    assert {(r["rule"], r["verdict"]) for r in bare.collect()} == {(None, "allow")} and bare.count() == len(urls)


def test_empty_tables(empty):
    assert mixing.mixture(empty).count() == mixing.draw(empty).count() == packing.pack(empty).count() == 0
    assert suffixes.repeats(empty).count() == sharding.shuffle_shards(empty, 3).count() == 0
    assert simhash.edited_fingerprints(empty).count() == pivots.near_duplicates(empty).count() == 0
