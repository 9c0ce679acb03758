"""Operators that work on one text at a time: round trips, brute force, odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from postlake.llm import bpe, langid, media, secret_scan, token_counts
from postlake.llm.streams import Remembered
from postlake.runtime import Scratch
from tests.llm.helpers import DOCS, ODD

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, b"m", [1]) for r in ODD], DOCS + ", n_bytes int, media binary, secrets array<int>")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# -- media -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("frames", [1, 2, 16, 17, 63, 64, 65, 128, 129, 1000])
def test_media_round_trip(frames):
    payload = random.Random(frames).randbytes(192 * frames)
    stored = media.write_media(payload)
    (t,) = media.read_tracks(stored)
    assert media.read_payload(stored, t) == payload
    assert (t["codec"], t["handler"], t["duration"], len(t["sizes"])) == ("raw ", "vide", frames * 1000, frames)
    assert [stored[o : o + n] for o, n in t["keys"].tolist()] == [payload[i * 192 : i * 192 + 192] for i in range(0, frames, 16)]


def box(kind, *parts):
    body = b"".join(parts)
    return (8 + len(body)).to_bytes(4, "big") + kind + body


def full(kind, *numbers, flags=0, tail=b""):
    return box(kind, flags.to_bytes(4, "big"), *((n % 2**32).to_bytes(4, "big") for n in numbers), tail)


def movie(*tables, timescale=1000, extra=b"", edits=b""):
    """A file of one track with the given sample tables, and 1,000 bytes of payload."""
    entry = box(b"abcd", bytes(8))
    stbl = box(b"stbl", full(b"stsd", 1, tail=entry), *tables)
    mdia = box(b"mdia", full(b"mdhd", 0, 0, timescale, 77, 0), full(b"hdlr", 0, int.from_bytes(b"soun", "big"), 0, 0, 0), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", 0, 0, 1, *[0] * 17), edits, mdia)
    return box(b"moov", trak, extra) + box(b"mdat", bytes(range(250)) * 4)


def test_media_times_sizes_and_edits():
    head = len(movie(full(b"stsz", 0, 5, 10, 20, 30, 40, 50), full(b"stsc", 2, 1, 2, 1, 2, 3, 1), full(b"stco", 2, 0, 0), full(b"stts", 2, 3, 100, 2, 50), full(b"ctts", 2, 4, 0, 1, -10), full(b"stss", 2, 1, 4))) - 1000
    (t,) = media.read_tracks(movie(full(b"stsz", 0, 5, 10, 20, 30, 40, 50), full(b"stsc", 2, 1, 2, 1, 2, 3, 1), full(b"stco", 2, head + 100, head + 300), full(b"stts", 2, 3, 100, 2, 50), full(b"ctts", 2, 4, 0, 1, -10), full(b"stss", 2, 1, 4)))
    assert (t["duration"], t["codec"], t["handler"]) == (400, "abcd", "soun")
    assert (t["offsets"] - head).tolist() == [100, 110, 300, 330, 370] and t["times"].tolist() == [0, 100, 200, 300, 340]
    assert (t["keys"] - [head, 0]).tolist() == [[100, 10], [330, 40]] and t["key_times"].tolist() == [0, 300]
    # compact sizes of 4, 8 and 16 bits, and an edit list
    for field, raw in ((4, bytes([0x12, 0x30])), (8, bytes([1, 2, 3])), (16, bytes([0, 1, 0, 2, 0, 3]))):
        tables = (full(b"stz2", field, 3, tail=raw), full(b"stsc", 1, 1, 3, 1), full(b"stco", 1, 900), full(b"stts", 1, 3, 10))
        (t,) = media.read_tracks(movie(*tables, edits=box(b"edts", full(b"elst", 1, 30, 5, 0x10000))))
        assert t["sizes"].tolist() == [1, 2, 3] and t["edits"] == [(30, 5)] and t["duration"] == 30


def test_fragmented_media():
    none = (full(b"stsz", 0, 0), full(b"stsc", 0), full(b"stco", 0), full(b"stts", 0))
    start = movie(*none, extra=box(b"mvex", full(b"trex", 1, 1, 40, 7, 0x10000)))
    moof = lambda at: box(b"moof", box(b"traf", full(b"tfhd", 1, flags=0x20000), full(b"trun", 3, at, 0, 100, 5, 200, 6, 300, 7, flags=0x305), full(b"trun", 2)))
    size = len(moof(0))
    file = start + moof(size + 8) + box(b"mdat", bytes(32))
    (t,) = media.read_tracks(file)
    first = len(start) + size + 8
    assert t["sizes"].tolist() == [5, 6, 7, 7, 7] and t["offsets"].tolist() == [first, first + 5, first + 11, first + 18, first + 25]
    assert t["times"].tolist() == [0, 100, 300, 600, 640] and t["duration"] == 680 and (t["keys"] - [first, 0]).tolist() == [[0, 5]]


def test_foreign_media():
    assert media.read_tracks(b"") == [] and media.read_tracks(b"\0\0\0\x08moov" * 3) == [] and media.read_tracks(b"junk" * 50) == []
    stored = media.write_media(b" " * 1920)
    # the payload is cut off, so the samples aren't there
    assert media.read_tracks(stored[:-200]) == [] and media.read_tracks(stored[:200]) == []
    # 64-bit sizes and boxes before the movie: offsets are those of the file, so they must move too
    big = b"\0\0\0\x01free" + (24).to_bytes(8, "big") + b"12345678"
    (t,) = media.read_tracks(big + stored)
    assert t["offsets"][0] == media.read_tracks(stored)[0]["offsets"][0]
    # contradicting and boastful tables neither raise nor allocate what they claim
    ok = {"stsz": full(b"stsz", 0, 3, 10, 20, 30), "stsc": full(b"stsc", 1, 1, 3, 1), "stco": full(b"stco", 1, 900), "stts": full(b"stts", 1, 3, 10)}
    assert len(media.read_tracks(movie(*ok.values()))) == 1
    for odd in (full(b"stsc", 2, 5, 1, 1, 2, 1, 1), full(b"stsc", 2, 2, 1, 1, 1, 1, 1), full(b"stco", 1, 2**32 - 5), full(b"stsz", 0, 3)):
        name = odd[4:8].decode()
        assert len(media.read_tracks(movie(*(ok | {name: odd}).values()))) <= 1
    for odd in (full(b"stsz", 1, 2**32 - 1), full(b"stsc", 1, 1, 2**32 - 1, 1), full(b"stts", 1, 2**32 - 1, 2**32 - 1), full(b"stss", 2**32 - 1, 1)):
        for t in media.read_tracks(movie(*(ok | {odd[4:8].decode(): odd}).values())):
            assert len(t["sizes"]) < 5000


def test_mutated_media_never_raises():
    rng = random.Random(6)
    files = [media.write_media(bytes(192 * 40)), movie(full(b"stsz", 0, 3, 10, 20, 30), full(b"stsc", 1, 1, 3, 1), full(b"stco", 1, 900), full(b"stts", 1, 3, 10)), movie(full(b"stsz", 0, 0), full(b"stsc", 0), full(b"stco", 0), extra=box(b"mvex", full(b"trex", 1, 1, 40, 7, 0))) + box(b"moof", box(b"traf", full(b"tfhd", 1), full(b"trun", 3, 0, 9, flags=0x205)))]
    for n in range(3000):
        raw = bytearray(files[n % 3])
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(min(len(raw), 700))
            raw[at] = rng.choice([0, 1, 255, rng.randrange(256)])
        for t in media.read_tracks(bytes(raw)):
            assert len(t["sizes"]) <= len(raw) and len(media.read_payload(bytes(raw), t)) == int(t["sizes"].sum())


def test_media_query(docs):
    got = {r["doc_id"]: r for r in media.media_features(media.store_media(docs)).collect()}
    for r in docs.collect():
        raw = r["text"].encode()
        payload = raw + b" " * (-len(raw) % 192)
        g = got[r["doc_id"]]
        assert (g["n_bytes"], g["payload_bytes"], g["payload_sha256"], g["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert g["media_sha256"] == hashlib.sha256(media.write_media(payload)).hexdigest()
        frames = len(payload) // 192
        at = g["media_bytes"] - len(payload)  # the payload ends the file
        keys = [(at + 192 * i, 192) for i in range(0, frames, 16)]
        assert g["keyframes"] == ",".join(f"{o}+{n}" for o, n in keys)
        crc = zlib.crc32(b"".join(x.to_bytes(8, "little") for k in keys for x in k))
        assert g["feature"] == f"raw |{frames / 25:.3f}|{frames}|{len(keys)}|{crc:08x}"


def test_media_odd_rows(spark, odd, none):
    got = media.media_features(media.store_media(odd)).collect()
    assert len(got) == len(ODD) and all(r["payload_bytes"] == 192 and r["n_bytes"] == 0 for r in got if r["doc_id"] in (4, 5, 6))
    assert len({tuple(r)[1:] for r in got if r["doc_id"] in (4, 5, 6)}) == 1
    assert media.media_features(media.store_media(none)).collect() == []
    tracks = media.probe_media(media.store_media(odd).limit(3)).select("tracks").collect()
    assert all(len(r["tracks"]) == 1 and r["tracks"][0]["keyframes"] for r in tracks)
    foreign = spark.createDataFrame([(1, 5, b"junk!"), (2, 0, None), (3, 0, b"")], "doc_id long, n_bytes long, media binary")
    assert [(r["payload_bytes"], r["feature"], r["media_bytes"]) for r in media.media_features(foreign).collect()] == [(None, None, 5), (None, None, 0), (None, None, 0)]
    assert all(r["tracks"] == [] for r in media.probe_media(foreign.withColumn("tracks", F.lit(1))).collect())


# -- secrets -----------------------------------------------------------------------------------------

PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def base_spans(text):
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(PATTERNS) for m in p.finditer(text) if ok(m)]
    return [f"{name}:{a}:{b}" for a, _, name, b in sorted(found)]


def spans_of(text):
    raw = text.encode()
    s = secret_scan.scanner()
    return [f"{s.kinds[k].name}:{a}:{b}" for a, b, k in secret_scan.code_points(raw, s.scan(raw))]


def test_scan_equals_plain_expressions():
    rng = random.Random(2)
    parts = ["password", "Token", "SECRET", "api_key", "apiKey", "passwd", ":", "=", " ", '"', "'", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", "x", "é", "zz-_.", "\n", "AKIAAKIA", "f", "ſ", "K"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(25)))
        assert [x for x in spans_of(t) if x.split(":")[0] in ("assign", "access", "hex")] == base_spans(t), t


def test_checksums_decide():
    body = "a1B2" * 7 + "xy"
    crc, tail = zlib.crc32(body.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        tail = secret_scan.BASE62[d] + tail
    assert spans_of(f"é ghp_{body}{tail}.") == ["code_token:2:42"]
    assert spans_of(f"ghp_{body}{tail[:-1]}{'0' if tail[-1] != '0' else '1'}") == []
    assert spans_of("card number: 4111 1111 1111 1111") == ["card:0:32"] and spans_of("card number: 4111 1111 1111 1112") == []


@pytest.mark.parametrize("kind", secret_scan.BASE + secret_scan.CHECKED, ids=lambda k: k.name)
def test_keywords_lose_no_match_of_any_kind(kind):
    rng = random.Random(5)
    token = "0" * 30  # with its checksum
    crc, tail = zlib.crc32(token.encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        tail = secret_scan.BASE62[d] + tail
    parts = ["card", "Card", "CARD", " number", " no", ".", ":", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_", token + tail, token + "000000", "password", "Token", "api_key", "APIKEY", "passwd", "secret", "=", '"', "0123456789abcdef01", "AKIA", "ABCDEF0123456789", "é", "\n"]
    s, pattern, found = secret_scan.scanner(), re.compile(kind.pattern, kind.flags), 0
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(12))).encode()
        want = [m.span() for m in pattern.finditer(t) if kind.accept(m)]
        assert [(a, b) for a, b, k in s.scan(t) if s.kinds[k] is kind] == want, t
        found += len(want)
    assert found > 20


@pytest.mark.parametrize("text", ["Card 4111 1111 1111 1111", "card. 4111 1111 1111 1111", "card4111-1111-1111-1111"])
def test_cards_without_a_word_between(text):
    assert spans_of(text) == [f"card:0:{len(text)}"]


def test_secret_query(docs, odd, none):
    got = {r["doc_id"]: r for r in secret_scan.span_digests(secret_scan.scan_documents(docs)).collect()}
    for r in docs.collect():
        want = base_spans(r["text"])
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (g["n_assign"], g["n_access"], g["n_hex"]) == tuple(sum(x.startswith(n) for x in want) for n in ("assign", "access", "hex"))
    rows = secret_scan.span_digests(secret_scan.scan_documents(odd)).collect()
    assert len(rows) == len(ODD) and {r["base_sha256"] for r in rows} == {EMPTY_SHA}
    assert secret_scan.scan_documents(none).collect() == []


def test_redaction(spark, none):
    rows = [(1, "é token = 0123456789abcdef01 end", "en", "s", 30), (2, "clean", "en", "s", 5), (3, None, "en", "s", None)]
    got = {r["doc_id"]: r for r in secret_scan.redact_documents(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[1]["text"] == "é <assign> end" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "clean" and got[2]["n_chars"] == 5 and got[3]["text"] is None and got[3]["n_chars"] is None
    assert secret_scan.redact_documents(none).collect() == []
    for kind, value in (("string", "many"), ("double", 3.5), ("array<int>", [1])):
        other = spark.createDataFrame([(1, "token = 0123456789abcdef01", value)], f"doc_id long, text string, n_chars {kind}")
        (r,) = secret_scan.redact_documents(other).collect()
        assert r["text"] == "<assign>" and r["n_chars"] == value


# -- byte-pair encoding ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(docs, odd, none, library):
    for df in (docs, odd):
        want = {}
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.setdefault(r["doc_id"], set()).add((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        rows = bpe.token_digests(bpe.encode_documents(df, digests=True)).collect()
        assert len(rows) == df.count() and all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) in want[r["doc_id"]] for r in rows)
    assert bpe.token_digests(bpe.encode_documents(none, digests=True)).collect() == []
    assert bpe.encode_documents(docs, decoded=False).columns == ["doc_id", "input_ids"]


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghij", "éàüñß", "漢字仮名", "0123", "!?%$", " \n\t", "aeiou tn", "it's 'll <|endoftext|>"])
def test_tree_concatenation_is_exact(alphabet, library):
    rng = random.Random(alphabet)
    e = bpe.load(*bpe.public_vocabulary())
    for size in (1, 900, 5000, 12_000):
        text = "".join(rng.choice(alphabet) for _ in range(size))
        for t in (text, f"say {text} <|endoftext|> end", text + "  \n " + text):
            ids = e.encode(t)
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids and e.decode(ids) == t
    for unit in ("a", "the", "==", "漢"):
        assert e.encode(unit * 9000).tolist() == library.encode(unit * 9000, add_special_tokens=False).ids


def test_texts_of_the_tables_are_joined(docs, library, monkeypatch):
    """Most documents have several leaves; with short leaves their joins fall on all kinds of places."""
    e, joins = bpe.load(*bpe.public_vocabulary()), []
    texts = [r["text"] or "" for r in docs.collect()]
    own = bpe.ByteBPE.join_texts
    monkeypatch.setattr(bpe.ByteBPE, "join_texts", lambda self, a, b: joins.append(1) or own(self, a, b))
    for leaf in (1024, 37, 3):
        monkeypatch.setattr(bpe, "LEAF", leaf)
        before = len(joins)
        for t in texts if leaf == 1024 else texts[::7]:
            assert e.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(joins) - before > 300


@pytest.mark.parametrize("seed", range(6))
def test_joins_anywhere_are_exact(seed, library, monkeypatch):
    rng = random.Random(seed)
    e = bpe.load(*bpe.public_vocabulary())
    parts = ["a", "the", " the", "  ", "\n", " \n ", "\t", "'", "'s", "'re", "'l", "l", "ve", "12", "345", "!", "!!", "...", "é", "漢字", "\u00a0", "\u2003", "\u0085", "\x1c", "😀", "Σ", " ", "x" * 30, "-" * 9, "\r\n", "ſ", "٣"]
    for _ in range(400):
        monkeypatch.setattr(bpe, "LEAF", rng.choice([1, 2, 3, 5, 8, 13]))
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 60)))
        ids = e.encode(t)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
        assert e.decode(ids) == t


TEXTS = {
    "code": "a.b(c);" * 30_000,
    "clauses": "".join("，" if i % 13 == 12 else chr(0x4E00 + i * 7919 % 20_000) for i in range(40_000)),
    "prose": " ".join(f"w{'aeiou'[i % 5]}rd{'s' * (i % 3)}" for i in range(20_000)),
    "one word": "abcde" * 8_000,
    "marks": "e\u0301a\u0300" * 10_000,
    "quotes": "don't'll've" * 4_000,
}


@pytest.mark.parametrize("name", TEXTS)
def test_little_more_than_the_text_is_encoded(name, library, monkeypatch):
    e, seen, text = bpe.load(*bpe.public_vocabulary()), [0], TEXTS[name]
    leaf, piece = e._leaf, e._bytes
    monkeypatch.setattr(e, "_leaf", lambda t: seen.append(len(t.encode())) or leaf(t))
    monkeypatch.setattr(e, "_bytes", lambda b: seen.append(len(b)) or piece(b))
    assert e.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    assert sum(seen) < 1.1 * len(text.encode())


# -- token counts ------------------------------------------------------------------------------------


def best_count(token, pieces):
    unknown = min(pieces.values()) - token_counts.UNKNOWN
    best = [(0.0, 0)]
    for i in range(1, len(token) + 1):
        size = len(token[i - 1].encode())
        found = (best[-1][0] + size * unknown, best[-1][1] + size) if token[i - 1] not in pieces else (float("-inf"), 0)
        for j in range(max(0, i - 24), i):
            if token[j:i] in pieces:
                s, n = best[j][0] + pieces[token[j:i]], best[j][1] + 1
                if s > found[0] or (s == found[0] and n < found[1]):
                    found = (s, n)
        best.append(found)
    return best[-1][1]


def test_counts_equal_one_lattice_a_word(docs, odd, none):
    pieces = token_counts.load_pieces(token_counts.public_pieces())
    for df in (docs.limit(60), odd):
        want = {}
        for r in df.collect():
            words = (r["text"] or "").split()
            counts = {w: best_count("▁" + w, pieces) for w in set(words)}
            want.setdefault(r["doc_id"], []).append((len(r["text"] or ""), len(words), sum(counts[w] for w in words)))
        got = {}
        for r in token_counts.count_tokens(df).collect():
            got.setdefault(r["doc_id"], []).append(tuple(r)[1:])
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_counts.count_tokens(none).collect() == []


def test_long_distinct_words_are_held_within_a_bound(monkeypatch):
    """Words of 10,000 characters, as in text without blanks: what tasks hold is bounded by bytes, not by their number."""
    import pyarrow as pa

    words = [chr(0x4E00 + i) * 10_000 for i in range(40)]
    sizes = []

    class Watched(token_counts.Counter):
        def update(self, *a):
            super().update(*a)
            sizes.append(sum(map(len, self)))

    monkeypatch.setattr(token_counts, "Counter", Watched)
    batches = [pa.RecordBatch.from_arrays([pa.array([f"{w} short {w}"] * 2)], names=["text"]) for w in words]
    (got,) = token_counts._repeated(iter(batches))
    assert got.to_pydict() == {"word": ["short"], "n": [80]} and max(sizes) == 5
    held = Remembered(len)
    assert [held[w.encode()] for w in words] == [30_000] * 40 and not held
    assert held[b"x"] == 1 and list(held) == [b"x"]
    monkeypatch.setattr(Remembered, "LIMIT", 3)
    assert [held[b"%d" % i] for i in range(10)] == [1] * 10 and len(held) <= 3


def test_long_paths_are_computed_again(monkeypatch):
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -1.5}
    monkeypatch.setattr(token_counts, "KEEP", 5)
    trie = token_counts.TokenTrie(pieces)
    rng = random.Random(5)
    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(300)]
    for w in words + sorted(words):
        assert trie.count(w) == best_count(w, pieces)


def test_shared_prefixes_are_scored_once():
    pieces = {"▁": -1.0, "a": -2.0, "b": -2.0, "ab": -2.5, "▁a": -1.5}
    trie = token_counts.TokenTrie(pieces)
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"c" * 200, "c" * 300})
    for w in words:
        assert trie.count(w) == best_count(w, pieces)
    assert trie.nodes == len({w[:i] for w in words for i in range(1, len(w) + 1)})


def test_rare_and_long_words_count_like_frequent_ones(spark, docs, monkeypatch):
    pieces = token_counts.load_pieces(token_counts.public_pieces())
    rows = [(i, r["text"]) for i, r in enumerate(docs.limit(30).collect())] + [(50, "漢字" * 900), (51, "x" * 5000 + " y"), (51, "x" * 5000 + " y"), (None, "z" * 200), (52, None)]
    want = [(i, len(t or ""), len((t or "").split()), sum(best_count("▁" + w, pieces) for w in (t or "").split())) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for often, held, known, scored in ((50, 100, 60, 10), (10**6, 10**6, 10**8, 10**6), (0, 10, 10, 1)):
        for name, value in (("OFTEN", often), ("HELD", held), ("KNOWN", known), ("SCORED", scored)):
            monkeypatch.setattr(token_counts, name, value)
        few = token_counts.frequent_counts(df, Scratch(spark, "t"), token_counts.public_pieces())
        assert len(few) <= often and all(best_count("▁" + w, pieces) == n for w, n in few.items())
        assert sorted(map(tuple, token_counts.count_tokens(df).collect()), key=str) == sorted(want, key=str)


# -- languages ---------------------------------------------------------------------------------------


def test_profiles_equal_a_plain_count(docs):
    from collections import Counter

    rows = docs.limit(50).collect()
    want = {}
    for r in rows:
        for word in re.findall(r"[^\W\d_]+", r["text"].lower()):
            p = f" {word} "
            grams = [p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1)]
            want.setdefault(r["lang"], Counter()).update(g for g in grams if g != " ")
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    got = langid.fit_profiles(docs.limit(50), size=80)
    for lang, counts in want.items():
        top = [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:80]
        assert [langid.ngram_text(c) for c in got[lang]] == top


def test_predictions_equal_plain_out_of_place_distances(docs):
    from collections import Counter

    size = 60
    profiles = langid.fit_profiles(docs.limit(80), size=size)
    places = {lang: {langid.ngram_text(c): i for i, c in enumerate(codes)} for lang, codes in profiles.items()}
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    rows = docs.limit(80).collect()
    got = {r["doc_id"]: r for r in langid.identify(docs.limit(80), profiles, size=size).collect()}
    for r in rows:
        grams = Counter()
        for word in re.findall(r"[^\W\d_]+", (r["text"] or "").lower()):
            p = f" {word} "
            grams.update(g for n in (1, 2, 3) for i in range(len(p) - n + 1) if (g := p[i : i + n]) != " ")
        if not grams:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        own = [g for g, _ in sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))][:size]
        far = {lang: sum(min(abs(at[g] - i), size) if g in at else size for i, g in enumerate(own)) / (size * len(own)) for lang, at in places.items()}
        best = min(sorted(far), key=far.get)
        score = 1 / sum(np.exp(-langid.SHARP * (d - far[best])) for d in far.values())
        assert got[r["doc_id"]]["lang_pred"] == best and got[r["doc_id"]]["score"] == pytest.approx(score)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = langid.identify(docs, langid.fit_profiles(docs.where(~held))).join(docs.where(held).select("doc_id", "lang"), "doc_id").collect()
    assert len(found) > 150 and np.mean([r["lang"] == r["lang_pred"] for r in found]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_odd_rows(odd, none, docs):
    profiles = langid.fit_profiles(docs)
    rows = langid.identify(odd, profiles).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (4, 5, 6, 7))
    assert langid.identify(none, profiles).collect() == [] and langid.fit_profiles(none) == {}
    assert {r["lang_pred"] for r in langid.identify(odd, {}).collect()} == {"und"}
    assert langid.fit_profiles(docs.withColumn("lang", F.lit(None).cast("string"))) == {}
