"""Operators 8, 9 and 10 against the libraries and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import packing, pieces, tokenfile
from strandlake.llm.tokens import library_encoder

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXTS = ["", " ", "  a  b ", "\n\n x  y 　 z  ", "it's  a\t b\n c 'S  é é \x1c q", " <|endoftext|> x <s> <0x41>", "a  b   ", "▁ a▁ b ▁▁ c▁▁ ", "日本語 😀 text\x00x", "Ünïcode “quotes” 12345 foo_bar—baz", "é Å  x  y", " lead", "x" * 3000]
#: Words of which a polynomial hash modulo 2**64 cannot tell each other apart, and words longer than a table keeps.
THUE = ["a"]
while len(THUE[-1]) < 2048:
    THUE.append(THUE[-1] + THUE[-1].translate(str.maketrans("ab", "ba")))
THUE = [w for t in THUE[3:] for w in (t, t.translate(str.maketrans("ab", "ba")))]
TEXTS += [*THUE, " ".join(THUE), " ".join(reversed(THUE)), "long" * 20000 + " word"]


def random_texts(seed, n):
    rng = random.Random(seed)
    alphabet = "ab cdE  \n\té▁'s1.,!? 　日😀<|>_"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize(("name", "style"), [("word_bpe_49k.json", "blank"), ("byte_bpe_50k.json", "spaced")])
def test_encoder_equals_the_library(name, style):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    texts = TEXTS + random_texts(1, 800)
    got = library_encoder(path, style).encode(pa.array([*texts, None]))
    for text, ids in zip(texts, got, strict=False):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(got) == len(texts) + 1 and not len(got[-1])


def test_pieces_equal_the_library():
    model, encoder = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    texts = TEXTS + random_texts(2, 800)
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == model.encode(texts)


def test_a_table_that_overflows():
    encoder = library_encoder.__wrapped__(public_tokenizers.path("byte_bpe_50k.json"), "spaced")
    encoder.table.most = 50
    texts = random_texts(3, 300)
    fresh = library_encoder(public_tokenizers.path("byte_bpe_50k.json"), "spaced")
    assert [x.tolist() for x in encoder.encode(pa.array(texts))] == [x.tolist() for x in fresh.encode(pa.array(texts))]


def test_pieces_query(odd_docs, no_docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model, _ = pieces.load(path)
    got = sorted(map(tuple, pieces.encode_decode(odd_docs, path).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = model.encode(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces.encode_decode(no_docs, path).count() == 0


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_decreasing(seed):
    rng = random.Random(seed)
    window = rng.choice([8, 16, 50])
    items = [rng.randint(1, window) for _ in range(rng.randint(0, 60))]
    bins = []
    for length in sorted(items, reverse=True):
        open_ = [(window - b, i) for i, b in enumerate(bins) if window - b >= length]
        if open_:
            bins[min(open_)[1]] += length
        else:
            bins.append(length)
    made, count = {}, Counter()
    for length, _, n, first, per, offset in packing.best_fit_decreasing(Counter(items), window):
        for i in range(n):
            made.setdefault(first + i // per, []).append((offset + i % per * length, length))
            count[length] += 1
    assert count == Counter(items) and sorted(made) == list(range(len(made)))
    for placed in made.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(sum(n for _, n in p) for p in made.values()) == sorted(bins)


def test_packing(odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = packing.pack(odd_docs, path, 1, window=64).collect()
    docs = {r.doc_id: library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in odd_docs.collect()}
    seen = Counter()
    for r in got:
        ids = docs[r.doc_id][r.start : r.start + r.length]
        assert r.doc_tokens == len(docs[r.doc_id]) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        seen[r.doc_id] += r.length
    assert seen == Counter({k: len(v) * (2 if k == 1 else 1) for k, v in docs.items()})
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by.values():
        assert [o for o, _ in sorted(placed)] == [sum(n for _, n in sorted(placed)[:i]) for i in range(len(placed))]
        assert sum(n for _, n in placed) <= 64
    assert packing.pack(no_docs, path, 1).count() == 0


@pytest.mark.parametrize("width", [1, 3, 7, 8, 9, 13, 16, 17, 20, 31])
def test_token_file(width):
    rng = np.random.default_rng(width)
    docs = [(i, rng.integers(0, 1 << width, rng.integers(0, 300)).astype(np.uint32)) for i in range(50)]
    file = tokenfile.TokenFile.from_bytes(tokenfile.to_bytes(docs, width, 128))
    for i, (doc, ids) in enumerate(docs):
        assert file.docs[i] == doc and np.array_equal(file.doc(i), ids)
    assert np.array_equal(file.ids(37, 999), np.concatenate([d for _, d in docs])[37:999])
    with pytest.raises(ValueError):
        tokenfile.to_bytes([(0, np.array([1 << width]))], width)


def test_many_files_and_splits(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, "x " * (i % 50)) for i in range(300)] + [(None, "n"), (7, "y")], "doc_id long, text string")
    folder = tokenfile.shared_dir(spark, "tokens")
    manifest = tokenfile.materialize(tokenfile.write_token_files(docs, folder, path, 50257, 0, 3, file_ids=500, file_docs=40), "manifest")
    files = manifest.collect()
    assert len(files) > 10 and max(f.n_docs for f in files) <= 40 and all(f.n_ids < 500 + 60 for f in files)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in tokenfile.read_token_files(manifest, folder, rows=7, split_ids=100).collect())
    assert [x[0] for x in got] == [0, *np.cumsum([x[2] for x in got]).tolist()][:-1]
    assert [x[1] for x in got] == [None, *sorted([*range(300), 7])]


@pytest.mark.parametrize("seed", range(2))
def test_ranks_of_split_lengths(spark, monkeypatch, seed):
    monkeypatch.setattr(packing, "RANK_ROWS", 5)
    rng = random.Random(seed)
    rows = [(i, 0, rng.choice([16, 16, 3, 5, 9]), 0, 16) for i in range(200)]
    cut = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    by = {}
    for r in packing.place(cut, 16).collect():
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(map(len, by.values())) == 200 and sorted(by) == list(range(len(by)))
    assert all(sum(n for _, n in p) <= 16 and [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] for p in by.values())


def test_token_files(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.round_trip(spark, odd_docs, path, 50257, 0).collect())
    at, want = 0, []
    for doc, text in sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        want.append((at, doc, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want and tokenfile.width_of(50257) == 16
    assert tokenfile.round_trip(spark, no_docs, path, 50257, 0).count() == 0
