"""Each operator against brute force, an exact round trip, or held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanweave.llm import balance, chat, components, langid, license_scan, oddsketch, outliers, packing, runindex, spotsigs, textscan, toxicity
from tests.conftest import DATA

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n", "a", "  b ", "one two", "One two three", "ÄÖ é x y", "x\n\nx\nx", "don't  stop 's", "　wide", "<|endoftext|> a", "a " * 300, "🙂🙂 🙂"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


def _frame(spark, texts):
    return spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "doc_id long, text string")


def test_words_and_windows_follow_the_regular_expression():
    for row, n, data, ends in textscan.pieces(pa.array([*ODD, None])):
        words = textscan.scan_words(data, ends)
        raw = data.tobytes()
        for d in range(n):
            own = [raw[s:e].decode() for s, e in zip(words.start[words.first[d] : words.first[d + 1]], words.end[words.first[d] : words.first[d + 1]])]
            assert own == SPACED.findall(([*ODD, None][row + d]) or "")
        same = [textscan.windows(words, 2)[0] for _ in range(2)]
        assert (same[0] == same[1]).all()


def test_pieces_cover_all_rows_whatever_their_size(monkeypatch):
    monkeypatch.setattr(textscan, "PIECE_BYTES", 10)
    some = ["abc", None, "x" * 50, "", "defg", "h" * 9, "ij"]
    back = []
    for _, n, data, ends in textscan.pieces(pa.array(some)):
        back += [data[ends[d] : ends[d + 1]].tobytes().decode() for d in range(n)]
    assert back == [t or "" for t in some]


def test_license_places_equal_brute_force(spark):
    some = ["CC BY cc-by", "all rights reserved; ALL RIGHTS, reserved", "general public", "cc", "x cc by cc by y", "The GNU General Public License v3", "Licensed under the Apache License, Version 2.0", "licensed under a apache license version 2.0", *ODD]
    got = {r.id: r for r in license_scan.scan(_frame(spark, some)).collect()}
    for n, text in enumerate(some):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(UPPER))
        at = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        places = sorted(i for i, _ in at)
        row = got[n]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(at), places[0] if at else None, places[-1] if at else None)
        assert row.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, row.base_labels.split(","))) <= set(row.labels.split(","))
    assert got[6].labels == "apache-2.0" and got[7].labels == "apache-2.0" and got[6].score == 1.0


def _places(words, phrase):
    return sum(words[i : i + len(phrase)] == phrase for i in range(len(words)))


def test_phrases_of_one_word_and_of_hundreds(spark):
    rng = random.Random(5)
    long = {n: [f"w{rng.randrange(n)}" for _ in range(n)] for n in (63, 64, 65, 80, 129, 300)}
    base = {"Warranty": "one"} | {" ".join(p): f"long{n}" for n, p in long.items()}
    texts = ["warranty, WARRANTY no", "no-warranty.", "", None, " ".join(long[300][:-1])]
    for n, p in long.items():
        texts += [" ".join(["x", *p, "y", *p]), " ".join([*p[: n // 2], "put", "in", *p[n // 2 :]]), " ".join(p[1:])]
    some = dict(enumerate(texts))
    rows = license_scan.scan(_frame(spark, texts), base=base, notices={}).collect()
    for r in rows:
        words = [w for w in re.split(license_scan.SEPARATORS, (some[r.id] or "").lower()) if w]
        found = {label: _places(words, phrase.lower().split()) for phrase, label in base.items()}
        assert r.n_words == len(words) and r.n_base == sum(found.values())
        assert r.base_labels == ",".join(sorted(k for k, v in found.items() if v))


def test_long_notices_are_scored_by_their_covered_words(spark):
    notice = [f"n{i}" for i in range(300)]
    changed = [("other" if i % 50 == 7 else w) for i, w in enumerate(notice)]
    some = {0: " ".join(notice), 1: " ".join(["a", *changed, "b"]), 2: " ".join(notice[:150]), 3: " ".join([*notice[:100], "put", "in", *notice[100:]])}
    got = {r.id: r for r in license_scan.scan(_frame(spark, list(some.values())), base={}, notices={" ".join(notice): "long"}).collect()}
    assert [got[n].labels for n in range(4)] == ["long", "long", "", "long"]
    assert got[0].score == 1.0 and got[1].score == pytest.approx(294 / 300) and got[3].score == 1.0
    with pytest.raises(ValueError):
        license_scan.scan(_frame(spark, list(some.values())), base={" - ": "none"})


def test_text_statistics_equal_brute_force(spark, texts):
    some = [*ODD, *texts.values()]
    got = {r.doc_id: r for r in outliers.text_statistics(_frame(spark, some), "text", ["doc_id"]).collect()}
    for n, text in enumerate(some):
        words = SPACED.findall(text)
        lines = [x for x in text.split("\n") if SPACED.search(x)]
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts, cover = Counter(windows), set()
        for i, w in enumerate(windows):
            if counts[w] > 1:
                cover.update(range(i, i + 5))
        row = got[n]
        assert row.n_words == len(words) and row.word_chars == sum(map(len, words))
        assert row.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert row.n_dup_lines == len(lines) - len(set(lines)) and row.n_repeat_words == len(cover)


def test_mcd_resists_a_third_of_outliers(spark):
    rng = np.random.default_rng(1)
    good = rng.normal([1, 0, 0, 0.1], [0.2, 0.5, 0.5, 0.1], (400, 4))
    bad = rng.normal([3, 4, 0, 0.9], 0.1, (100, 4))
    rows = spark.createDataFrame([(0, x.tolist()) for x in np.vstack([good, bad])], "grp long, x array<double>")
    fit = outliers.mcd(rows, 4).first()
    assert np.abs(np.array(fit.centre) - [1, 0, 0, 0.1]).max() < 0.15
    inverse = np.array(fit.inverse).reshape(4, 4)
    far = lambda x: np.einsum("ni,ij,nj->n", x - fit.centre, inverse, x - fit.centre) / fit.scale > outliers.CHI_LIMIT
    assert far(bad).all() and far(good).mean() < 0.01


def test_language_is_found_in_held_out_texts(docs):
    dealt = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.train(docs.where(dealt != 2))
    found = langid.predict(docs.where(dealt == 2), model, carry=["lang", "text"]).collect()
    right = [r.lang == r.lang_pred for r in found if len(r.text) > 40]
    assert sum(right) >= 0.9 * len(right)
    assert all(0 <= r.score <= 1 for r in found)
    assert len(langid.label_positions(model, "the é")) == 6


def test_bptt_gradient_equals_finite_differences():
    rng = np.random.default_rng(0)
    reader, data, push = langid.Reader.fresh(rng), rng.integers(0, 256, (5, 3)), rng.normal(size=(5, 3, langid.STATE))
    value = lambda: float((reader.forward(data)[0] * push).sum())
    d_in, d_st = reader.backward(data, reader.forward(data)[1], push)
    for weights, grad in ((reader.states, d_st), (reader.inputs, d_in)):
        at = tuple(rng.integers(0, s) for s in weights.shape) if weights is reader.states else (int(data[2, 1]), 4)
        before, step = weights[at], 1e-6
        weights[at] = before + step
        up = value()
        weights[at] = before - step
        assert abs((up - value()) / (2 * step) - grad[at]) < 1e-5
        weights[at] = before


def test_chunked_ids_equal_those_of_whole_texts(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    some = [*ODD, *list(texts.values())[:60]]
    tok = packing.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    for first, n, data, ends in textscan.pieces(pa.array(some)):
        ids, at = tok.encode(data, ends)
        for d in range(n):
            assert ids[at[d] : at[d + 1]].tolist() == whole.encode(some[first + d], add_special_tokens=False).ids


def test_packed_ids_equal_the_tokenizer_with_its_added_tokens(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    some = [*ODD, f"a {mark} b", mark, mark * 3, f"x  {mark}  {mark}é", f"<|endo{mark}ftext|>", "<|endof", "text|>", f"ab{mark}cd 's"]
    assert whole.encode(some[len(ODD)], add_special_tokens=False).ids == [64, 220, 50256, 275]
    rows = packing.pack(_frame(spark, some), public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    for n, text in enumerate(some):
        own = sorted((r for r in rows if r.doc_id == n), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == [*whole.encode(text, add_special_tokens=False).ids, packing.END_ID]


def test_pieces_are_powers_of_two_and_give_the_document_back(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    some = [*ODD, "word " * 3000, None]
    rows = packing.pack(_frame(spark, some), path).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert [r.length for r in sorted(rows, key=lambda r: r.sequence_id)] == sorted((r.length for r in rows), reverse=True)
    for n in range(len(some)):
        own = sorted((r for r in rows if r.doc_id == n), key=lambda r: r.start)
        ids = [i for r in own for i in r.ids]
        assert ids[-1] == packing.END_ID and len(ids) == own[0].doc_tokens
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)]).tolist()[:-1]
        for r in own:
            assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and len(r.ids) == r.length
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_packing_stage_gives_ids_and_digests_follow_them(spark):
    import corpus_pipeline

    some = [*ODD, "word " * 3000, None]
    packed = corpus_pipeline.pack(spark, _frame(spark, some), "").cache()
    rows = {r.sequence_id: r for r in packed.collect()}
    assert all(len(r.ids) == r.length for r in rows.values())
    found = packing.digests(packed)
    assert found.columns == [c for c in packed.columns if c != "ids"]
    for r in found.collect():
        assert r.asDict() == {k: v for k, v in rows[r.sequence_id].asDict().items() if k != "ids"}
    # The digest is that of the ids in the row, not one carried along.
    changed = packing.digests(packed.withColumn("ids", F.transform("ids", lambda i: i + 1)))
    assert all(r.ids_crc32 == zlib.crc32((np.array(rows[r.sequence_id].ids) + 1).astype("<u4").tobytes()) for r in changed.collect())


def test_matching_statistics_equal_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(1, 6))]
        parts += [parts[0] + b"abab" * 8] if rng.random() < 0.5 else []
        longest, offset, runs = runindex.matching_statistics(parts)
        places = [(a, i) for a, p in enumerate(parts) for i in range(len(p) + 1)]

        def common(x, y):
            p, q = parts[x[0]][x[1] :], parts[y[0]][y[1] :]
            return next((n for n, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))

        assert longest.tolist() == [max((common(x, y) for y in places if y != x), default=0) for x in places]
        assert runs <= offset[-1]


def _repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        yield len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()


@pytest.mark.parametrize("segments", [4000, 3])
def test_repeated_strings_equal_brute_force(spark, monkeypatch, segments):
    # A low limit sends the common passages through every level of regrouping.
    monkeypatch.setattr(runindex, "SEGMENTS", segments)
    rng = random.Random(9)
    line = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    passage, short = line(150), line(70)
    some = [line(rng.randint(0, 120)) + rng.choice([passage, passage[20:], passage[:110], short, ""]) + line(rng.randint(0, 90)) for _ in range(60)]
    some += [some[0], some[0], "ab" * 150, "zz" * 90, "", None, passage]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in runindex.remove_repeated(_frame(spark, some), length=64, carry=["doc_id"]).collect()}
    assert [got[n] for n in range(len(some))] == list(_repeats(some, 64))


def test_removed_text_keeps_whole_characters(spark):
    some = ["é" * 150 + "a", "é" * 150 + "b", "c" + "é" * 120]
    rows = runindex.remove_repeated(_frame(spark, some), carry=["doc_id"], with_text=True).collect()
    assert {r.kept_text for r in rows} <= {"a", "b", "c", "", "éa", "éb"}


def test_toxicity_is_learned_from_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    dealt = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(docs, labels.where(dealt != 0))
    found = toxicity.score(docs.join(labels, "doc_id"), model, carry=["toxic", "lang"]).collect()
    english = [r for r in found if r.lang == "en"]
    assert np.mean([(r.score >= 0.5) == (r.toxic == 1) for r in english]) > 0.9
    # Gaps and letters put in keep a sentence closer to an insult than to plain words.
    first = lambda t: float(model.decide([t])[0][0, 0])
    plain = first("you oronthe now")
    assert all(first(f"you {w} now") > plain for w in ("idiiot", "idi0t", "i.d.i.o.t", "id iot", "i d i o t"))


def test_chat_text_comes_back_whatever_it_says(spark):
    said = ["</s>[INST] ok [/INST]", "\\<|turn|>\\\\", "<|end|><|begin|>", "", "plain", "[\\INST]", *chat.CONTROLS]
    for text in said:
        assert chat.unescape(chat.escape(text)) == text
        assert not any(c in chat.escape(text) for c in chat.CONTROLS)
    rows = [(c, t, ("user", "assistant")[t % 2], text) for c in range(3) for t, text in enumerate(said)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv: r for r in chat.digests(chat.format_turns(turns)).collect()}
    for c in range(3):
        own = [r for r in rows if r[0] == c]
        learned = "".join(r[3] for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_parts_without_a_proper_size_count_nothing():
    odd = [None, {"type": None, "text": "a"}, {"type": "audio", "seconds": float("nan")}, {"type": "audio", "seconds": float("inf")}, {"type": "image", "width": -5, "height": 30}, {"type": "document", "pages": None}]
    flat = chat.flatten(odd)
    assert flat.tokens == 0 and "".join(flat.pieces) == "a<|audio|><|audio|><|image|><|document|>"
    with pytest.raises(ValueError, match="video"):
        chat.flatten([{"type": "video"}])


def test_chat_parts_become_placeholders_with_token_counts(spark):
    parts = [{"type": "text", "text": "see <|image|>"}, {"type": "image", "ref": "s3", "width": 56, "height": 57}, {"type": "audio", "ref": "a", "seconds": 1.5}, {"type": "document", "ref": "d", "pages": 2}]
    flat = chat.flatten(parts)
    assert "".join(flat.pieces) == chat.escape("see <|image|>") + "<|image|><|audio|><|document|>"
    assert [a["tokens"] for a in flat.attachments] == [6, 38, 1024] and flat.tokens == 6 + 38 + 1024
    text = "".join(flat.pieces)
    assert all(text[a["place"] :].startswith(chat.PLACEHOLDERS[a["type"]]) for a in flat.attachments)
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])
    turns = spark.createDataFrame([(1, 0, "user", [tuple(p.get(c) for c in ("type", "text", "ref", "width", "height", "seconds", "pages")) for p in parts])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    row = chat.format_turns(turns, text_col=None, parts_col="parts").first()
    assert row.tokens == flat.tokens and len(row.attachments) == 3


def test_spots_of_edited_and_next_texts(spark, docs, texts):
    got = {r.id: r for r in spotsigs.against_next(docs).collect()}
    order = sorted(texts, reverse=True)
    for n, d in enumerate(order):
        text, following = texts[d], texts[order[(n + 1) % len(order)]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert got[d].fingerprint == spotsigs.to_text(spotsigs._sets([text])[0])
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([r.near_edited > 0.3 for r in long]) > 0.95 and np.mean([r.near_next < 0.2 for r in long]) > 0.95
    by_text = defaultdict(set)
    for d, t in texts.items():
        by_text[t].add(got[d].fingerprint)
    assert all(len(s) == 1 for s in by_text.values())


def test_likeness_and_fingerprint_see_every_signature(spark):
    rng = random.Random(11)
    words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
    some = [" ".join(words), " ".join(words[:2990] + [f"x{n}" for n in range(10)]), "plain words here", ""]
    sets = [set(s.tolist()) for s in spotsigs._sets(some)]
    assert min(map(len, sets[:2])) > 4 * spotsigs.KEPT
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    got = {r.id: r for r in spotsigs.against_next(_frame(spark, some)).collect()}
    for n, text in enumerate(some):
        following = (n - 1) % len(some)
        edited = set(spotsigs._sets([spotsigs._edit(text, some[following])])[0].tolist())
        assert got[n].near_next == pytest.approx(like(sets[n], sets[following]))
        assert got[n].near_edited == pytest.approx(like(sets[n], edited))
    # One signature among many, in whatever place of the order, changes the fingerprint.
    full = np.arange(1, 1001, dtype=np.uint64)
    other = full.copy()
    other[-1] += np.uint64(5)
    assert spotsigs.to_text(full) != spotsigs.to_text(other) and 0.99 < spotsigs.likeness(full, other) < 1


def test_near_spot_pairs_equal_brute_force(docs, texts):
    sets = {d: set(s.tolist()) for d, s in zip(texts, spotsigs._sets(list(texts.values())))}
    first = {}
    for d in sorted(sets):
        first.setdefault(frozenset(sets[d]), d)
    reps = [d for d in first.values() if sets[d]]
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    expected = {frozenset((a, b)) for n, a in enumerate(reps) for b in reps[:n] if like(a, b) >= 0.7}
    assert {frozenset((r.a, r.b)) for r in spotsigs.near_pairs(docs, 0.7).collect()} == expected


def _components(sets, percent):
    parent = {d: d for d in sets}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: top(d) for d in sets}


def _shingles(text, k):
    words = SPACED.findall((text or "").translate(UPPER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def test_near_duplicates_equal_brute_force(spark, texts):
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 + str(n) for n in range(120)]
    group = []
    for n in range(60):
        words = list(base)
        for _ in range(n % 9):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        group.append(" ".join(words))
    some = [*texts.values(), *ODD, None, *group, group[0], group[0].upper()]
    got = {r.id: r for r in oddsketch.near_duplicates(_frame(spark, some), k=3, threshold=0.85).collect()}
    sets = {n: _shingles(t, 3) for n, t in enumerate(some)}
    assert {d: r.component_id for d, r in got.items()} == _components(sets, 85)
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(s) for d, s in sets.items()}


def test_bitmaps_estimate_high_similarity():
    rng = np.random.default_rng(2)
    bands = oddsketch.bands_for(0.85)
    samples = bands * oddsketch.BAND_ROWS
    limit = oddsketch.bitmap_limit(0.85, samples)
    for overlap, near in ((0.87, True), (0.3, False)):
        passed = 0
        for _ in range(30):
            pool = rng.integers(0, 2**63, 1000, dtype=np.uint64)
            shared = int(1000 * overlap)
            spare = (1000 - shared) // 2
            a, b = np.sort(pool[: shared + spare]), np.sort(np.append(pool[:shared], pool[shared + spare :]))
            maps = [oddsketch._bitmaps(oddsketch._minhashes(s, np.array([0, len(s)]), samples))[0] for s in (a, b)]
            passed += int(np.bitwise_count(maps[0] ^ maps[1]).sum()) <= limit
        assert passed == (30 if near else 0)


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 130)] + [(7, 7), (300, 200)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"))
    expected = {n: 0 for n in range(41)} | {n: 100 for n in range(100, 130)} | {200: 200, 300: 200}
    assert {r.node: r.component for r in found.collect()} == expected


def _targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[n % 3] for n, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = sum(weight[s] for s in names if s not in full)
        level = (total - sum(most * sizes[s] for s in full)) / left if left else 0
        over = {s for s in names if s not in full and weight[s] * level > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def test_mix_meets_its_targets_and_reruns_agree(docs, texts):
    rows = [r.asDict(recursive=True) for r in balance.mix_sources(docs).collect()]
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == len(SPACED.findall(r["_row"]["text"])) and 0 <= r["copies"] <= 2
        sizes[r["_row"]["source"]] += r["size"]
    targets = _targets(sizes)
    for source, target in targets.items():
        own = [r for r in rows if r["_row"]["source"] == source]
        assert own[0]["target"] == pytest.approx(target) and own[0]["source_size"] == sizes[source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - target) <= 0.02 * target + 5
    again = {(r._row.doc_id, r.copies) for r in balance.mix_sources(docs.repartition(5)).collect()}
    assert again == {(r["_row"]["doc_id"], r["copies"]) for r in rows}


def test_dual_keeps_the_mean_of_a_feature(spark):
    rows = [(0, s, float(s > 50)) for s in range(1, 101)]
    sizes = spark.createDataFrame(rows, "sid long, size long, big double")
    total = sum(s for _, s, _ in rows)
    sources = spark.createDataFrame([(0, total, 1.3 * total)], "sid long, source_size long, target double")
    lam = balance.solve_dual(sizes, sources, [balance.Aim("big", 0.0)]).first().lam
    rates = [np.exp(lam[0] + lam[1] * b) for _, _, b in rows]
    assert sum(r * s for r, (_, s, _) in zip(rates, rows)) == pytest.approx(1.3 * total)
    assert sum(r * s * b for r, (_, s, b) in zip(rates, rows)) == pytest.approx(1.3 * sum(s * b for _, s, b in rows))


def _bisect(rises, low, high):
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if rises(middle) < 0 else (low, middle)
    return (low + high) / 2


def _tilted(size, v, target, mean, most=2.0):
    """Rates min(most, exp(a + b v)) that meet the target and the mean, by nested bisection."""
    rate = lambda a, b: np.minimum(most, np.exp(np.minimum(a + b * v, 50)))
    a_of = lambda b: _bisect(lambda a: (size * rate(a, b)).sum() - target, -400, 400)
    b = _bisect(lambda b: (size * v * rate(a_of(b), b)).sum() / target - mean, -20, 20)
    return rate(a_of(b), b)


def _extreme(size, v, target, order, most=2.0):
    """The mean of ``v`` if the target is filled up in this order."""
    room, total = target, 0.0
    for i in order:
        used = min(room, most * size[i])
        room, total = room - used, total + used * v[i]
    return total / target


def test_rates_equal_a_bisected_dual_and_differ_within_a_source(spark):
    rng = np.random.default_rng(3)
    rows = [(s, int(n)) for s, (mid, many) in {"a": (5, 400), "b": (4.5, 300), "c": (5.5, 200), "d": (6, 100)}.items() for n in rng.lognormal(mid, 1, many)]
    frame = spark.createDataFrame([(i, s, " ".join(["w"] * n)) for i, (s, n) in enumerate(rows)], "doc_id long, source string, text string")
    got = balance.mix_sources(frame).select("_row.source", "size", "target", "rate", "copies").collect()
    every = np.array([r.size for r in got], float)
    classes = np.floor(np.log2(every + 1))
    corpus, differ = (every * classes).sum() / every.sum(), 0
    for source in "abcd":
        own = [n for n, r in enumerate(got) if r.source == source]
        size, v, target, rates = every[own], classes[own], got[own[0]].target, np.array([got[n].rate for n in own])
        mean = (size * v).sum() / size.sum()
        low, high = (mean + balance.REACH * (_extreme(size, v, target, o) - mean) for o in (np.argsort(v), np.argsort(-v)))
        wanted = min(max(corpus, low), high)
        assert (size * rates).sum() == pytest.approx(target, rel=1e-6)
        assert (size * v * rates).sum() / target == pytest.approx(wanted, rel=1e-6)
        if target < 2 * size.sum():
            filled = size > 0
            assert np.allclose(rates[filled], _tilted(size, v, target, wanted)[filled], rtol=1e-4, atol=1e-6)
        differ += len(set(np.round(rates, 6))) > 1
    assert differ >= 2


def test_copies_do_not_depend_on_the_order_of_rows_with_equal_or_no_ids(spark):
    rows = [(None if n % 3 else 7, "s" if n % 2 else None, " ".join(["w"] * (n % 40)) + f" t{n}", {"n": n}) for n in range(3000)]
    shape = "doc_id long, source string, text string, extra map<string,int>"
    seen = []
    for some in (rows, rows[::-1]):
        mixed = balance.mix_sources(spark.createDataFrame(some, shape).repartition(3), block_rows=100)
        seen.append(Counter((r._row.text, r.copies) for r in mixed.collect()))
    assert seen[0] == seen[1] and sum(seen[0].values()) == len(rows)


def test_an_aim_that_cannot_be_met_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(balance, "NEWTON_STEPS", 2)
    sizes = spark.createDataFrame([(0, s, float(s % 7)) for s in range(1, 101)] + [(1, 5000, 60.0)], "sid long, size long, v double")
    sources = spark.createDataFrame([(0, 5050, 3000.0), (1, 5000, 5000.0)], "sid long, source_size long, target double")
    with pytest.raises(ArithmeticError, match="source number 0"):
        balance.solve_dual(sizes, sources, [balance.Aim("v", 0.9)])
