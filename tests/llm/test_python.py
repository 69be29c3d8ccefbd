import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from llm.fixtures import frame, rows
from tokenizers import Tokenizer

from turnlake.llm import language_id, near_dedup, packing, sentence_pieces, token_counts, url_filters

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [" ", "  ", "\n", "\t", "a", "B", "é", "ß", "1", "½", "²", "\x1c", "\x85", "\xa0", "▁", "漢", "🙂", "_", "'s", "'LL", "<|endoftext|>", ".", "#", "\x00", "é", "Ⅷ", "٣", "ing"]


def fuzz(n=4000):
    rnd = random.Random(3)
    return ["".join(rnd.choices(ODD, k=rnd.randint(0, 30))) for _ in range(n)] + [chr(c) + "a " + chr(c) * 2 + " 1" + chr(c) for c in range(0x3000)] + ["x" * 3000, " " * 500, "ab" * 9000]


def library_ids(texts):
    return [e.ids for e in Tokenizer.from_file(BPE).encode_batch_fast(texts, add_special_tokens=False)]


def test_token_counts_match_the_library(spark):
    texts = fuzz()
    count = token_counts.counter(BPE).count
    assert [count(t) for t in texts] == [len(i) for i in library_ids(texts)]
    want = Counter((r[0], len((r[1] or "").encode()), n, n > 512) for r, n in zip(rows(), map(len, library_ids([r[1] or "" for r in rows()]))))
    assert Counter(map(tuple, token_counts.token_counts(frame(spark), BPE).collect())) == want
    assert token_counts.token_counts(frame(spark, []), BPE).count() == 0


def test_token_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "TABLE_TOKENS", 50)
    monkeypatch.setattr(token_counts, "TABLE_CHUNKS", 20)
    c = token_counts.TokenCounter(BPE)
    texts = [r[1] or "" for r in rows()]
    assert [c.count(t) for t in texts] == [len(i) for i in library_ids(texts)]
    assert len(c.tokens) <= 50 and len(c.chunks) <= 20


def test_sentence_pieces_match_the_library(spark, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = fuzz()
    table = sentence_pieces.PieceTable(PIECES)
    monkeypatch.setattr(sentence_pieces, "TABLE_ENTRIES", 500)
    for text, raw in zip(texts, table.encode(texts)):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == model.encode(text, add_bos=True, add_eos=True)
        assert table.decode(ids) == model.decode(ids)
    rnd = random.Random(4)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(3, 259), rnd.randrange(0, 32000), 0, 1, 2]) for _ in range(rnd.randint(0, 9))]
        assert table.decode(ids) == model.decode(ids)
    got = Counter(map(tuple, sentence_pieces.encode_decode(frame(spark), PIECES, digest=True).collect()))
    want = Counter()
    for r in rows():
        ids = model.encode(r[1] or "", add_bos=True, add_eos=True)
        want[r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()] += 1
    assert got == want
    back = sentence_pieces.encode_decode(frame(spark), PIECES)
    assert back.join(sentence_pieces.decode_ids(back, PIECES).withColumnRenamed("decoded", "d"), "doc_id").where("d <> decoded and doc_id > 20").count() == 0
    assert sentence_pieces.encode_decode(frame(spark, []), PIECES).count() == 0


def brute_verdict(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_url_rules_match_brute_force(spark):
    rnd = random.Random(8)
    labels = ["a", "b", "www", "com", "net", "A", "é", ""]
    rules = [("com", "/", "allow"), ("a.com", "/x/", "block"), ("b.a.com", "/x/y", "allow"), ("a.com", "/x/yz", "block"), ("net", "", "block"), ("www.net", "/x", "allow"), ("com", "/x/y", "block")]
    urls = [rnd.choice(["http://", "https://", "", "x://y://"]) + ".".join(rnd.choices(labels, k=rnd.randint(0, 4))) + rnd.choice(["", "/", "/x", "/x/", "/x/y", "/x/yz?q", "?/x/", "#a/x/", ":80/x/"]) for _ in range(600)]
    urls += [None, "", "://", "http://A.COM/x/yz"] + ["http://b.a.com/x/y"] * 900
    pages = spark.createDataFrame([(i if i else None, u, "h", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, verdict int").repartition(5)
    got = Counter(map(tuple, url_filters.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()))
    assert got == Counter((i if i else None, *brute_verdict(u, rules)) for i, u in enumerate(urls))
    assert url_filters.judge_urls(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    odd = pages.selectExpr("page_id as `a.b`", "url as `u.host`", "'x' as host", "1 as _id", "'y' as u")
    again = url_filters.judge_urls(odd, spark.createDataFrame(rules, "host string, path string, verdict string"), key="a.b", url="u.host")
    assert again.columns == ["a.b", "host", "path", "rule", "verdict"] and Counter(map(tuple, again.collect())) == got


def brute_fingerprint(text):
    words = [w.encode().lower() for w in (text or "").replace("\n", " ").replace("\t", " ").split(" ") if w]
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for k in range(i):
            if (prints[i] ^ prints[k]).bit_count() <= 4:
                root[find(i)] = find(k)
    return [find(i) for i in range(len(prints))]


def test_near_groups_match_brute_force(spark):
    data = rows()
    prints = [brute_fingerprint(r[1]) for r in data]
    groups = brute_groups(prints)
    least = {}
    for r, g in zip(data, groups):
        least[g] = min(x for x in (r[0], least.get(g)) if x is not None) if (r[0] is not None or least.get(g) is not None) else None
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(data, prints, groups))
    assert Counter(map(tuple, near_dedup.near_groups(frame(spark)).collect())) == want
    assert near_dedup.near_groups(frame(spark, [])).count() == 0


def test_links_of_planted_fingerprints(monkeypatch):
    rnd = random.Random(1)
    values = [rnd.getrandbits(64) for _ in range(40)]
    for v in values[:25]:
        for _ in range(rnd.randint(1, 5)):
            values.append(values[rnd.randrange(len(values))] ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(1, 6))}))
    values = list(dict.fromkeys(values))
    want = brute_groups(values)
    for direct in (4096, 10):
        monkeypatch.setattr(near_dedup, "DIRECT", direct)
        root = list(range(len(values)))
        at = {v: i for i, v in enumerate(values)}

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in near_dedup.spanning_links(np.array(values, "uint64")):
            for x, y in zip(a.tolist(), b.tolist()):
                assert (x ^ y).bit_count() <= 4
                root[find(at[x])] = find(at[y])
        got = [find(i) for i in range(len(values))]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_signatures_meet_at_four_bits(spark):
    rnd = random.Random(2)
    pairs = []
    for _ in range(300):
        v = rnd.getrandbits(64)
        w = v ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 4)))
        pairs.append(tuple(int(np.uint64(x).astype("int64")) for x in (v, w)))
    flat = spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")
    sigs = {}
    for r in near_dedup.signatures(flat).collect():
        sigs.setdefault(r.fp, set()).add(r.sig)
    assert all(len(s) == 64 for s in sigs.values())
    assert all(sigs[a] & sigs[b] for a, b in pairs)


def test_packing_is_valid_and_tight(spark):
    tok = Tokenizer.from_file(BPE)
    got = packing.pack(frame(spark), BPE).collect()
    want = Counter()
    for r in rows():
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [2]
        for nth, (start, n) in enumerate(packing.cut(len(ids))):
            want[r[0], nth, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter(tuple(g)[:5] for g in got) == want
    bins = {}
    for g in got:
        bins.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for b in bins.values():
        b.sort()
        assert all(o == sum(n for _, n in b[:i]) for i, (o, _) in enumerate(b)) and sum(n for _, n in b) <= 1024
    assert len(bins) <= 1.02 * -(-sum(g.length for g in got) // 1024) + 1
    assert packing.pack(frame(spark, []), BPE).count() == 0


def test_tokenizer_ids_match_the_library():
    texts = fuzz()
    own = packing.Tokenizer(BPE)
    assert [np.frombuffer(own.encode(t), "<u4").tolist() for t in texts] == library_ids(texts)


def test_genetic_operators_keep_all_pieces():
    rng = random.Random(6)
    counts = Counter(rng.randint(1, 1023) for _ in range(3000))
    same = lambda s: Counter({k: n for p, c in s.items() for k in () for n in ()}) or sum((Counter({k: m * c for k, m in Counter(p).items()}) for p, c in s.items()), Counter())
    a = packing.best_fit(Counter(), counts, 1024)
    b = packing.mutate(a, 1024, rng)
    c = packing.crossover(a, b, counts, 1024, rng)
    best = packing.evolve(counts, 1024, 1, [])
    for s in (a, b, c, best):
        assert same(s) == counts and all(sum(p) <= 1024 for p in s)
    assert packing.cost(best, 1024) <= packing.cost(a, 1024)
    assert packing.lower_bound(counts, 1024) <= sum(best.values()) <= 1.02 * packing.lower_bound(counts, 1024)


def test_languages_are_learned_and_held_out(spark):
    rnd = random.Random(7)
    alphabets = {"aa": "abcdeo", "bb": "fghijo", "cc": "klmnoé"}
    data = []
    for i in range(300):
        lang = rnd.choice(list(alphabets))
        text = " ".join("".join(rnd.choices(alphabets[lang], k=rnd.randint(2, 7))) for _ in range(25))
        data.append((i, text, lang, "s", 1, 7, "x", "y", "z", "k", 3))
    data += [(900, None, "aa", "s", 1, 7, "x", "y", "z", "k", 3), (901, "12 34 .", "aa", "s", 1, 7, "x", "y", "z", "k", 3), (None, "abc de", None, "s", 1, 7, "x", "y", "z", "k", 3)]
    docs = frame(spark, data)
    model = language_id.fit(docs.where(~language_id.held_out()))
    assert model.languages == ["aa", "bb", "cc"]
    got = {g.doc_id: g for g in language_id.predict(docs, model).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    held = [r for r in data if r[0] is not None and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert held and sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())
    empty = language_id.fit(docs.limit(0))
    assert {g.lang_pred for g in language_id.predict(docs, empty).collect()} == {"und"}


def brute_language_scores(counts, text):
    """Word-first backoff with plain dictionaries: scores of every language."""
    langs, padded = sorted(counts), lambda w: f"_{w}_"
    tables = []
    for order in (0, *language_id.ORDERS):
        seen = {la: Counter() for la in langs}
        for la in langs:
            for w, n in counts[la].items():
                for k in [w] if not order else [padded(w)[i : i + order] for i in range(len(w) + 3 - order)]:
                    seen[la][k] += n
        keys = {k for c in seen.values() for k in c}
        tables.append((order, keys, {la: (c, sum(c.values())) for la, c in seen.items()}))
    out = np.zeros(len(langs))
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        for order, keys, seen in tables:
            parts = [word] if not order else [padded(word)[i : i + order] for i in range(len(word) + 3 - order)]
            known = [p for p in parts if p in keys]
            if known:
                logs = [[math.log((c[p] + language_id.SMOOTHING) / (total + language_id.SMOOTHING * len(keys))) for c, total in seen.values()] for p in known]
                out += np.mean(logs, axis=0)
                break
    return out


def test_language_scores_match_brute_force():
    rnd = random.Random(11)
    word = lambda letters: "".join(rnd.choices(letters, k=rnd.randint(1, 8)))
    counts = {la: Counter(word(letters) for _ in range(300)) for la, letters in {"aa": "abcde", "bb": "cdefg漢字", "cc": "xyzé"}.items()}
    counts["cc"]["字" * 60] = 3
    scorer = language_id.Scorer(language_id.train(counts))
    for text in ("alpha beta", "", "abc cde 漢字 xyz é, zz-yy", "Q", "字" * 300, " ".join(word("abcdefgxyz漢é") for _ in range(400)), "字" * 60):
        want = brute_language_scores(counts, text)
        assert np.allclose(scorer.scores(text), want, atol=1e-3)
        scorer.learn([text])
        assert np.allclose(scorer.scores(text), want, atol=1e-3)
        if language_id.has_letter(text):
            p = np.exp(want - want.max())
            got = scorer.predict(text)
            assert got[0] == sorted(counts)[int(want.argmax())] and got[1] == pytest.approx(1 / p.sum(), abs=1e-3)


def test_many_languages_and_the_rarest_of_them(spark):
    """Seventy languages, of one only a few documents, in a script of long words without blanks."""
    rnd = random.Random(2)
    data = []
    for la in range(70):
        letters = [chr(0x4E00 + 40 * la + i) for i in range(20)]
        for i in range(3 if la == 69 else 12):
            data.append((1000 * la + i, " ".join("".join(rnd.choices(letters, k=rnd.choice((3, 5, 90)))) for _ in range(20)), f"l{la:02d}"))
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(docs, max_train=400)
    assert len(model.languages) == 70
    got = {g.doc_id: g.lang_pred for g in language_id.predict(docs, model).collect()}
    assert all(got[k] == la for k, _, la in data)


def test_the_sample_is_bounded(spark, monkeypatch):
    """More counts than the model may hold: the fit ends, each language keeps its most frequent ones and is still told apart."""
    data = [(i, " ".join("".join(random.Random(i * 99 + k).choices("abcde" if i % 2 else "vwxyz", k=5)) for k in range(40)), "ab"[i % 2]) for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string").repartition(3)
    full = {g.doc_id: g.lang_pred for g in language_id.predict(docs, language_id.fit(docs)).collect()}
    monkeypatch.setattr(language_id, "MODEL_ROWS", 50)
    model = language_id.fit(docs)
    assert 0 < len(model.words.lang) + sum(len(t.lang) for t in model.grams) <= 50
    assert {g.doc_id: g.lang_pred for g in language_id.predict(docs, model).collect()} == full == {k: la for k, _, la in data}


def test_very_long_texts_are_drawn_in_pieces(spark):
    rnd = random.Random(4)
    body = {la: "".join(rnd.choices(letters + " ", k=3_000_000)) for la, letters in (("aa", "abcdefgh"), ("bb", "opqrstuv"))}
    docs = spark.createDataFrame([(i, f"{i} {body[la]}", la) for i, la in enumerate(["aa", "bb"] * 3)], "doc_id long, text string, lang string").repartition(3)
    model = language_id.fit(docs, train_chars=400_000)
    assert {g.doc_id: g.lang_pred for g in language_id.predict(docs, model).collect()} == {i: ["aa", "bb"][i % 2] for i in range(6)}
    pieces = language_id.drawn_pieces(body["aa"], 0.1)
    assert 2 <= len(pieces) <= 50 and all(p in body["aa"] for p in pieces) and language_id.drawn_pieces("abc", 0.0) == ["abc"]


def test_a_hundred_thousand_values_of_lang(spark, monkeypatch):
    """A dirty column: the languages with most rows are learned, what the driver holds is bounded."""
    monkeypatch.setattr(language_id, "MAX_LANGUAGES", 30)
    dirty = spark.range(100_000).selectExpr("id as doc_id", "concat('word ', id) as text", "concat('x', id) as lang")
    clean = spark.createDataFrame([(-i, ("der die das " if i % 2 else "the that this ") * 9, "de" if i % 2 else "en") for i in range(1, 60)], "doc_id long, text string, lang string")
    model = language_id.fit(dirty.union(clean))
    assert len(model.languages) == 30 and {"de", "en"} <= set(model.languages)
    assert {g.lang_pred for g in language_id.predict(clean, model).collect()} == {"de", "en"}
    rates = language_id.draw_rates([("a", 10**9, 10**13), ("b", 5, 10**12), ("c", 5, 500)], 30_000, 64_000_000)
    assert rates["c"] == 1 and rates["a"] * 10**13 + rates["b"] * 10**12 <= 2 * 64_000_000


def test_numbers_are_no_letters():
    scorer = language_id.Scorer(language_id.train({"aa": {"alpha": 5}}))
    assert [scorer.predict(t)[0] for t in ("² ½ ٣ 12", "Ⅳ ①", "\u0301", "é")] == ["und", "und", "und", "aa"]
