"""Tokenising, toxicity, media columns, archives and the pipeline."""

import base64
import gzip
import hashlib
import os
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronobin.llm import media, sentencepieces, toxicity, warc

MODEL = pytest.mark.skipif(not os.path.exists(sentencepieces.MODEL), reason="no public model")
ODD = ["", " ", "a", "  a  b ", "\n\t x", "日本語テキスト😀 ok", "▁x▁y", "<s> </s> <0x0A> <unk>", "a" * 300, "ab " * 100 + "zzzz" * 50, "   " * 20, "é", "\x00\x01", "x\r\ny"]


@pytest.fixture(scope="module")
def model():
    return sentencepieces.Model(sentencepieces.read_model())


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)


@MODEL
def test_ids_equal_the_library(model, library):
    assert model.encode(ODD) == [library.encode(x) for x in ODD]
    assert [model.decode(library.encode(x)) for x in ODD] == [library.decode(library.encode(x)) for x in ODD]


@MODEL
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab the ▁\n.", max_size=120), max_size=5))
def test_any_text(model, library, texts):
    ids = model.encode(texts)
    assert ids == [library.encode(t) for t in texts]
    assert [model.decode(x) for x in ids] == [t.replace("▁", " ") for t in texts]


@MODEL
def test_suffix_array_finds_every_piece(model):
    text = " the quick brown fox and the other the\0banana"
    ids = model.char_id[[ord(c) for c in text.replace(" ", "▁")]]
    start, length, piece = model.edges(ids)
    escaped = text.replace(" ", "▁")
    want = sorted((i, len(model.pieces[p]), p) for p in model.multi for i in range(len(escaped)) if escaped.startswith(model.pieces[p], i))
    assert list(zip(start.tolist(), length.tolist(), piece.tolist(), strict=True)) == want


def tiny_model(pieces, algorithm):
    field = lambda n, data: bytes([n << 3 | 2, len(data)]) + data
    import struct

    out = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([3 << 3, kind])) for p, s, kind in pieces)
    return out + field(2, bytes([3 << 3, algorithm])) + field(3, field(1, b"identity") + bytes([3 << 3, 1, 4 << 3, 0]))


def test_unigram_takes_the_best_path():
    pieces = [("<unk>", 0, 2), ("▁", -1.0, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -4.0, 1), ("▁a", -2.0, 1), ("ba", -2.5, 1), ("aba", -9.0, 1)]
    m = sentencepieces.Model(tiny_model(pieces, sentencepieces.UNIGRAM))
    assert [m.pieces[i] for i in m.encode(["aba"])[0]] == ["▁a", "ba"]
    assert [m.pieces[i] for i in m.encode(["ab z"])[0]] == ["▁", "ab", "▁", "<unk>"] and m.encode([None]) == [[]]


@MODEL
def test_a_unit_without_cuts_is_indexed_in_windows(model, library, monkeypatch):
    """The index holds no more than ARRAY_CHARS and the longest piece; ids stay the library's."""
    monkeypatch.setattr(sentencepieces, "ARRAY_CHARS", 500)
    monkeypatch.setattr(sentencepieces, "SCAN", 20)
    fresh, sizes = sentencepieces.Model(sentencepieces.read_model()), []
    array = fresh.suffix_array
    monkeypatch.setattr(fresh, "suffix_array", lambda text: sizes.append(len(text)) or array(text))
    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdeinorst", k=5000)), "x" * 3000, " ".join("".join(rng.choices("eint", k=rng.randint(1, 60))) for _ in range(300))]
    assert fresh.encode(texts) == [library.encode(t) for t in texts]
    assert max(sizes) <= 2 * 500 + fresh.longest


@MODEL
def test_tokens_in_spark(spark, library):
    rows = [(k, t, "x", k) for k, t in enumerate([*ODD, *ODD, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, units long")
    got = {r.doc_id: r for r in sentencepieces.tokenise(df).collect()}
    assert {k: list(r.ids) for k, r in got.items()} == {k: library.encode(t or "") for k, t, _, _ in rows} and all(r.round_trip for r in got.values())
    back = sentencepieces.decode(sentencepieces.encode(df)).collect()
    assert all(r.decoded == (r.text or "").replace("▁", " ") for r in back)
    d = {r.id: r for r in sentencepieces.digest(df).collect()}
    assert d[4].n_tokens == len(library.encode(ODD[4])) and d[0].tokens_crc32 == 0 and sentencepieces.digest(df.limit(0)).count() == 0


# -- toxicity ------------------------------------------------------------------------------


def distance(a, b):
    """Insertions, deletions, substitutions and swaps of neighbours."""
    d = [list(range(len(b) + 1))] + [[i] + [0] * len(b) for i in range(1, len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), min_size=1, max_size=8), st.text("abcd", max_size=7))
def test_automaton_against_brute_force(words, token):
    trie = toxicity.Trie(words)
    want = min(((distance(token, w), w) for w in words if distance(token, w) <= 1), default=(None, None))[1]
    assert trie.within(token) == want and (want is None or trie.may_match(token))


def toxic_corpus(n=1500):
    rng = random.Random(4)
    common, rude = [a + b for a in ("ba", "de", "fi", "go", "lu", "mor", "sta") for b in ("nek", "pos", "rit", "tam", "vul")], ["worthless", "scumbag", "nitwit"]
    docs, labels = [], []
    for i in range(n):
        words, bad = rng.choices(common, k=rng.randint(5, 80)), rng.random() < 0.2
        if bad:
            for _ in range(rng.randint(1, 3)):
                w = rng.choice([*rude, "skruppa" + rng.choice("abcdefg")])
                if len(w) > 6 and rng.random() < 0.2:
                    w = w[:3] + rng.choice("0xq") + w[4:]
                words.insert(rng.randrange(len(words)), w)
        docs.append((i, " ".join(words), None, 9.0, 1))
        labels.append((i, 1, int(bad)))
    docs += [(n, None, "en", 1.0, 0), (n + 1, "", "en", 1.0, 0), (None, "worthless scumbag", "en", 1.0, 0), (5, docs[5][1], "fr", 0.0, 0), (n + 2, "calm " * 30_000 + "you worthless nitwit scumbag", "", 0.0, 0)]
    return docs, [*labels, (n, None, None), (None, 1, 1), (5, 1, labels[5][2])]


def test_toxicity(spark):
    docs, labels = toxic_corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, y int")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    held = {i for i, _, _ in labels if i is not None and zlib.crc32(str(i).encode()) % 5 == 0}
    marks = d.select("doc_id", toxicity.held_out(d.doc_id).alias("h")).collect()
    assert {r.doc_id for r in marks if r.h and r.doc_id is not None and r.doc_id < 1500} == {i for i in held if i < 1500}
    got = {(r.doc_id, r.text): r._s for r in toxicity.with_scores(d, model, into="_s").collect()}
    truth = {i: t for i, _, t in labels}
    right = [(got[i, t] >= 0.5) == bool(truth[i]) for i, t, *_ in docs if i in held and truth[i] is not None]
    assert len(right) > 200 and sum(right) / len(right) >= 0.97
    assert got[1500, None] == got[1501, ""] < 0.5 and got[None, "worthless scumbag"] > 0.5 and got[1502, docs[-1][1]] > 0.5
    assert toxicity.fit(d, lab.limit(0)) == toxicity.Toxicity() and toxicity.Toxicity().score("worthless") == 0.0
    assert toxicity.with_scores(d.limit(0), model, into="_s").count() == 0


def test_context_separates_quotation_from_abuse():
    m = toxicity.Toxicity({"scumbag": 3.0, "worthless": 3.0}, {"skrup": 2.0}, [1.0, 1.0, 1.0, -0.5, 0.5, 0.5, 0.0, -3.0])
    plain, quoted, direct = (m.features(t) for t in ("the scumbag left", 'she said "scumbag" and left', "you are a scumbag"))
    assert direct[0] > plain[0] > quoted[0] and quoted[3] > 0 == plain[3] and m.score("you scumbag") > m.score('he wrote "scumbag" once')
    assert m.features("a scumb4g here")[2] > 0 and m.features("skruppel")[0] == 2.0 and m.features("") == m.features(None) == [0.0] * toxicity.FEATURES


def test_learned_model_tells_quotation_from_abuse(spark):
    """The same words quoted in clean documents and hurled in toxic ones; labels that conflict count as toxic."""
    rng = random.Random(7)
    common, rude = [a + b for a in ("ba", "de", "fi", "go", "lu", "mor") for b in ("nek", "pos", "rit", "tam")], ["worthless", "scumbag", "nitwit"]
    docs, labels = [], []
    for i in range(2000):
        words, kind = rng.choices(common, k=rng.randint(10, 40)), rng.choice(["plain"] * 6 + ["abuse"] * 3 + ["quote"])
        at = rng.randrange(len(words))
        if kind == "abuse":
            words[at:at] = ["you", rng.choice(rude), rng.choice(rude)]
        elif kind == "quote":
            words[at:at] = ["she", "said", '"' + rng.choice(rude) + '"', "and", "left"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind == "abuse")))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*labels, *[(i, 0) for i, y in labels if y][:50]], "doc_id long, toxic int")
    model = toxicity.fit(d, lab)
    again = toxicity.fit(d.repartition(3), lab.repartition(5))
    assert (model.words, model.stems) == (again.words, again.stems) and model.coefficients == pytest.approx(again.coefficients)
    held = [(t, y) for (i, t), (_, y) in zip(docs, labels, strict=True) if zlib.crc32(str(i).encode()) % 5 == 0]
    quoted = [model.score(t) for t, y in held if not y and '"' in t]
    abuse = [model.score(t) for t, y in held if y]
    assert len(quoted) > 20 and sum(s < 0.5 for s in quoted) >= 0.9 * len(quoted) and sum(s >= 0.5 for s in abuse) >= 0.95 * len(abuse)
    assert model.score("go bapos you wrothless scumbga nitwit") > 0.5 > model.score('he wrote "scumbag" once and left it there')


def test_words_that_copies_share_are_not_learned(spark):
    """A toxic document with a hundred near copies, whose other words are in no other document."""
    rng = random.Random(9)
    common, odd = [a + b for a in ("ba", "de", "fi", "go", "lu", "mor") for b in ("nek", "pos", "rit", "tam")], [f"odd{c}word" for c in "abcdefghijklmnopqrstuvwxyz"] * 4
    docs = [(i, " ".join([*rng.choices(common, k=30), *["worthless"] * (i % 8 == 0)]), int(i % 8 == 0)) for i in range(800)]
    docs += [(1000 + i, " ".join([*odd, "worthless", common[i % 5]]), 1) for i in range(100)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    again = toxicity.fit(rows.select("doc_id", "text").repartition(7), rows.select("doc_id", "toxic"))
    assert "worthless" in model.words and not any(w.startswith("odd") for w in [*model.words, *model.stems]) and model.words == again.words
    assert model.score("babnek worthless") > 0.5 > model.score("oddaword oddbword")


# -- media ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=7000))
def test_transport_stream_round_trip(payload):
    raw = media.mux(payload)
    s = media.demux(raw)
    assert s.payload == payload and s.continuity_errors == 0 and len(raw) % media.PACKET == 0 and s.packets == len(raw) // media.PACKET
    assert s.pts == [k * media.TICKS for k in range(len(s.pts))] and s.pcr == [s.pts[k] for k in s.random_access] and (s.program, s.stream_type) == (1, 6)


def test_lost_packets_and_broken_streams():
    raw = media.mux(bytes(range(256)) * 100)
    p = media.PACKET
    assert media.demux(raw[: 5 * p] + raw[6 * p :]).continuity_errors == 1
    for broken in (raw[:-1], b"\0" * p, raw[:20] + b"\x99" + raw[21:]):
        with pytest.raises(ValueError):
            media.demux(broken)
    assert len(media.demux(raw).random_access) == -(-len(media.demux(raw).pts) // media.RAP_EVERY)


def packet(pid, counter, payload, start=False, adapt=None, control=0x10):
    """A packet made by hand; what is short is stuffed in the adaptation field."""
    room = 184 - len(payload)
    if adapt is not None or room:
        body = b"" if room == 1 and adapt is None else (adapt or b"\x00").ljust(room - 1, b"\xff")
        payload, control = bytes([len(body)]) + body + payload, control | 0x20
    assert len(payload) == 184
    return bytes([0x47, (0x40 if start else 0) | pid >> 8, pid & 255, control | counter & 15]) + payload


def table(table_id, number, body):
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    crc = 0xFFFFFFFF
    for bit in (b >> k & 1 for b in head for k in range(7, -1, -1)):
        crc = (crc << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if crc >> 31 ^ bit else 0)
    return b"\x00" + head + crc.to_bytes(4, "big")


def entry(pid, kind, info=b""):
    return bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info


def foreign():
    """Two programs after a network entry; program 7 has video without PES lengths, some without timestamps, and audio; its map spans two packets."""
    pat = table(0, 1, b"\0\0\xe0\x10" + b"\0\x07\xe1\x00" + b"\0\x08\xe2\x00")
    long_map = table(2, 7, b"\xe1\x01\xf0\x00" + entry(0x101, 0x1B, b"d" * 150) + entry(0x102, 0x0F, b"e" * 40))
    small_map = table(2, 8, b"\xe2\x01\xf0\x00" + entry(0x201, 0x06))
    video = b"\0\0\x01\xe0\0\0\x80\x80\x05" + b"\x21\x00\x07\xd8\x61" + b"V" * 300
    bare = b"\0\0\x01\xe0\0\0\x80\x00\x00" + b"W" * 20
    audio = b"\0\0\x01\xc0" + (3 + 50).to_bytes(2, "big") + b"\x80\x00\x00" + b"A" * 50 + b"stuffing"
    return [
        packet(0, 0, pat.ljust(184, b"\xff"), True), packet(0x100, 0, long_map[:184], True), packet(0x100, 1, long_map[184:].ljust(184, b"\xff")), packet(0x200, 0, small_map.ljust(184, b"\xff"), True),
        packet(0x1FFF, 0, b"n" * 184), packet(0x101, 14, video[:100], True, b"\x40"), packet(0x101, 15, video[100:284]), packet(0x101, 0, video[284:]), packet(0x102, 3, audio, True),
        packet(0x101, 1, bare, True), packet(0x201, 9, b"\0\0\x01\xbd\0\x04\x80\x00\x00Z", True),
    ]


def test_foreign_streams():
    raw = foreign()
    s = media.demux(b"".join(raw))
    assert list(s.streams) == [0x101, 0x102, 0x201] and s.packets == len(raw)
    v, a, z = s.streams.values()
    assert v.payload == b"V" * 300 + b"W" * 20 and v.pts == [126000, None] and v.random_access == [0] and v.offsets == [5 * 188, 9 * 188] and not v.continuity_errors
    assert (a.payload, a.pts, a.program, a.stream_type) == (b"A" * 50, [None], 7, 0x0F) and (z.payload, z.program) == (b"Z", 8)
    twice = media.demux(b"".join(raw[:6] + [raw[5]] + raw[6:8] + [raw[7]] + raw[8:]))
    assert (twice.payload, twice.random_access, twice.continuity_errors) == (v.payload, [0], 0)
    thrice = media.demux(b"".join(raw[:7] + [raw[6]] * 2 + raw[7:]))
    assert thrice.continuity_errors == 1
    assert media.demux(b"".join(raw[:6] + raw[7:])).continuity_errors == 1
    jump = packet(0x101, 7, b"\0\0\x01\xe0\0\0\x80\x00\x00J", True, b"\x80")
    assert media.demux(b"".join([*raw, jump])).continuity_errors == 0 and media.demux(b"".join([*raw, jump])).payload.endswith(b"WJ")
    scrambled = packet(0x101, 2, b"x" * 184, True, control=0x90)
    damaged = bytearray(raw[0])
    damaged[20] ^= 1
    empty = packet(0, 0, table(0, 1, b"\0\0\xe0\x10").ljust(184, b"\xff"), True)
    for broken in (b"", b"".join([*raw, scrambled]), bytes(damaged) + b"".join(raw[1:]), b"".join(raw[1:]), empty + b"".join(raw[1:]), b"".join([*raw[:-1], packet(0x201, 9, b"\0\0\x01\xbd\0\x09\x80\x00\x00Z", True)]), b"".join([*raw, packet(0x101, 2, b"no code", True)])):
        with pytest.raises(ValueError):
            media.demux(broken)


def test_media_columns(spark):
    rows = [(1, "x"), (2, None), (3, ""), (4, "é" * 96), (5, "z" * 50_000), (5, "z" * 50_000), (None, "n")]
    df = spark.createDataFrame([(i, t, 1, "f") for i, t in rows], "doc_id long, text string, media_bytes int, feature string")
    stored = media.store(df.select("doc_id", media.padded(df.text).alias("payload")), "payload")
    got = media.parse(stored).collect()
    for i, t in rows:
        raw = (t or "").encode()
        raw += b" " * (192 if not raw else -len(raw) % 192)
        r = next(r for r in got if r.doc_id == i)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.mux(raw)), hashlib.sha256(media.mux(raw)).hexdigest()) and "cc_errors=0" in r.feature
    assert len(got) == len(rows) and media.parse(stored.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "x", "y", None), (2, "x", "y", bytearray(media.mux(b"abc")))], "doc_id long, pts string, feature string, media binary")
    assert [(r.doc_id, r.payload_bytes, r.pts) for r in media.parse(clash).orderBy("doc_id").collect()] == [(1, None, None), (2, 3, [0])]
    at = next(r for r in got if r.doc_id == 5)
    assert all(media.mux(b"z" * 50_000 + b" " * 112)[at.packet_offsets[k] + 5] & 0x40 for k in at.random_access)


# -- archives ------------------------------------------------------------------------------


def test_archive(spark, tmp_path):
    rows = [(5, "http://a/b c", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, None), (8, "http://e", ""), (7, "http://l", "x" * 300_000), (3, "http://b", "<p>é</p>"), (None, "http://n", "<p>é</p>"), (None, "http://m", "only")]
    df = spark.createDataFrame([(*r, "t", 1) for r in rows], "page_id long, url string, html string, record_type string, payload int")
    folder = f"file://{tmp_path}/w"
    warc.archive(df, folder)
    got = spark.read.format("warc").load(folder).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        raw, first = (h or "").encode(), least.get(h or "")
        again = first is not None and i != first
        want.append((f"urn:page:{'' if i is None else i}", "revisit" if again else "response", len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), f"urn:page:{first}" if again else None, None if again else raw))
    assert sorted(((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, r.payload and bytes(r.payload) if r.payload is None or len(r.payload) else b"") for r in got), key=str) == sorted(want, key=str)
    read = lambda **o: spark.read.format("warc").options(**o).load(folder)
    hits = read(payload="false").where("record_type = 'revisit' AND refers_to = 'urn:page:3'")
    assert hits.count() == 2 and "payload" not in hits.columns
    assert read().where("record_id LIKE 'urn:page:7%'").count() == 1 and read().where("refers_to IS NULL").count() == sum(w[4] is None for w in want)
    assert read().where("payload_bytes > 1000").count() == 1
    # Files that no manifest names are never read, and members are plain gzip.
    (tmp_path / "w" / "part-lost.warc.gz").write_bytes(warc.record("urn:page:77", "response", None, None, b"lost"))
    assert read().count() == len(rows)
    part = max((tmp_path / "w").glob("part-*.warc.gz"), key=lambda p: p.stat().st_size)
    assert gzip.decompress(part.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: ")
    warc.archive(df.limit(0), f"file://{tmp_path}/none")
    assert spark.read.format("warc").load(f"file://{tmp_path}/none").count() == 0


def test_damage_and_pushdown(tmp_path):
    data = warc.record("urn:page:1", "response", "http://x", None, b"abc") + warc.record("urn:page:2", "response", "http://y", None, b"d" * 500_000)
    (tmp_path / "a.warc.gz").write_bytes(data)
    reader = warc.Reader(str(tmp_path), True)
    assert list(reader.pushFilters([warc.EqualTo(("record_id",), "urn:page:2"), warc.EqualTo(("payload_bytes",), 3)])) == [warc.EqualTo(("payload_bytes",), 3)]
    assert [b.column("record_id").to_pylist() for b in reader.read(warc.Range(str(tmp_path / "a.warc.gz"), 0, len(data)))] == [["urn:page:2"]]
    (tmp_path / "a.warc.gz").write_bytes(b"junk" + data)
    with pytest.raises(ValueError):
        list(warc.Reader(str(tmp_path), True).read(warc.Range(str(tmp_path / "a.warc.gz"), 0, 9)))


def foreign_archive():
    """Records as other writers make them, and what must be read of each."""
    body = "<p>é</p>".encode()
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + body
    made = [
        ([b"WARC/1.0", b"WARC-Type:warcinfo", b"WARC-Record-ID: <urn:uuid:1>", b"Content-Type: application/warc-fields"], b"software: y\r\n\r\nmore"),
        ([b"WARC/1.0", b"warc-type: response", b"WARC-Record-ID: <urn:uuid:2>", b"WARC-Target-URI: http://a/", b"WARC-Payload-Digest: sha1:" + digest.encode(), b"Content-Type: application/http;\r\n msgtype=response"], http),
        ([b"WARC/1.0", b"WARC-Type: metadata", b"WARC-Record-ID: <urn:uuid:3>"], b""),
        ([b"WARC/1.0", b"WARC-Type: resource", b"WARC-Record-ID: <urn:uuid:4>", b"WARC-Payload-Digest: md5:abc"], b"r" * 300_000),
        ([b"WARC/1.0", b"WARC-Type: response", b"WARC-Record-ID: <urn:uuid:5>", b"WARC-Payload-Digest: sha1:" + b"A" * 32, b"Content-Type: application/http"], b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n0\r\n\r\n"),
    ]
    records = [b"\r\n".join([*h, b"Content-Length:" + str(len(b)).encode()]) + b"\r\n\r\n" + b + b"\r\n\r\n" for h, b in made]
    want = [("warcinfo", "urn:uuid:1", 23 - 3, b"software: y\r\n\r\nmore"), ("response", "urn:uuid:2", len(body), body), ("metadata", "urn:uuid:3", 0, b""), ("resource", "urn:uuid:4", 300_000, b"r" * 300_000), ("response", "urn:uuid:5", 18, b"3\r\nabc\r\n0\r\n\r\n")]
    want = [(t, i, len(p), p) for t, i, _, p in want]
    return records, want


@pytest.mark.parametrize(("name", "pack"), [("a.warc", b"".join), ("b.warc.gz", lambda rs: b"".join(map(gzip.compress, rs))), ("c.warc.gz", lambda rs: gzip.compress(b"".join(rs))), ("d.warc.gz", lambda rs: gzip.compress(b"".join(rs[:2])) + gzip.compress(b"".join(rs[2:])))])
def test_archives_of_others(spark, tmp_path, name, pack):
    """Plain files, a gzip member a record, and members of many records; nothing names lengths or ends lines as our writer does."""
    records, want = foreign_archive()
    (tmp_path / name).write_bytes(pack(records))
    warc.register(spark)
    read = lambda **o: spark.read.format("warc").options(**o).load(str(tmp_path))
    assert [(r.record_type, r.record_id, r.payload_bytes, bytes(r.payload)) for r in read().collect()] == want
    assert [(r.record_type, r.record_id, r.payload_bytes) for r in read(payload="false").where("record_type = 'response'").collect()] == [w[:3] for w in want if w[0] == "response"]
    assert read().where("target_uri = 'http://a/'").count() == 1
    (tmp_path / name).write_bytes(pack([*records, records[1].replace(b"<p>", b"<q>")]))
    with pytest.raises(Exception, match="does not match"):
        read().collect()
    (tmp_path / name).write_bytes(pack([*records, b"junk" * 10]))
    with pytest.raises(Exception, match="record"):
        read().collect()


# -- pipeline ------------------------------------------------------------------------------


@MODEL
def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs, labels = toxic_corpus(800)
    clean = [(i, t) for (i, t, *_), (_, _, y) in zip(docs, labels, strict=False) if i is not None and i < 800 and not y]
    rows = [(d[0], d[1], "en", f"s{k % 4}", len(d[1] or "")) for k, d in enumerate(docs)] + [(2000 + k, clean[0][1], "en", "s0", 1) for k in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash", "mixing", "sentencepiece"]
    columns, ids = kept.columns, []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns[: len(columns)] == columns and (k == 3 or kept.columns == columns)
        kept.write.parquet(f"{tmp_path}/stage{k}")
        kept = spark.read.parquet(f"{tmp_path}/stage{k}")
        ids.append({r.doc_id for r in kept.select("doc_id").collect()})
    toxic = {i for i, _, y in labels if y and i is not None and i < 800}
    assert len(toxic & ids[0]) < 0.05 * len(toxic) and len({i for i, _ in clean} - ids[0]) < 0.02 * len(clean)
    assert len(ids[1] & {clean[0][0], *range(2000, 2050)}) == 1 and ids[1] <= ids[0] and ids[3] == ids[2] <= ids[1]
    assert kept.where("NOT round_trip").count() == 0
    result = pipeline.run(spark, str(tmp_path))
    assert result.count() == kept.count()


@MODEL
def test_pipeline_against_brute_force(spark, tmp_path, library):
    """run()'s rows, each stage once more in plain Python over the rows that the one before kept."""
    import re
    from collections import Counter, defaultdict

    import numpy as np
    from test_tables import water_fill

    pipeline = pytest.importorskip("corpus_pipeline")
    texts, labels = toxic_corpus(600)
    ids = list(dict.fromkeys(i for i, *_ in texts if i is not None))
    kept = [(i, next(t for j, t, *_ in texts if j == i), "abc"[i % 3]) for i in ids]
    kept += [(5000 + k, kept[k][1], None) for k in range(0, 90, 3)] + [(6000, None, "a"), (6001, "", "b"), (6002, "one two", None), (None, "no id here", "c")]
    spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in kept], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    n = len(kept)
    kept = [r for r in kept if model.score(r[1]) < 0.5]
    assert len(kept) < n
    # Jaccard similarity of the sets of five-word shingles, over all pairs; texts without words are one group.
    words = [(t or "").lower().split() for _, t, _ in kept]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    label = np.arange(len(kept))
    for a in range(len(kept)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if label[a] != label[b] and (not both or len(sets[a] & sets[b]) / both >= 0.8):
                label[label == label[b]] = label[a]
    groups = defaultdict(list)
    for r, x in zip(kept, label.tolist(), strict=True):
        groups[x].append(r)
    assert len(groups) < len(kept)
    kept = [min(g, key=lambda r: (r[0] is None, r[0])) for g in groups.values()]
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, want = defaultdict(int), Counter()
    for _, t, s in kept:
        sizes[s] += size(t)
    for s, target in water_fill(sizes).items():
        passes, cum = int(target // sizes[s]), 0
        budget = target - passes * sizes[s]
        key = lambda i: hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15]
        for i, t, _ in sorted((r for r in kept if r[2] == s), key=lambda r: key(r[0])):
            here = size(t)
            more = cum + here <= budget or (cum <= budget and (budget - cum) * 2 >= here)
            cum += here
            want[i, t, s, tuple(library.encode(t or ""))] += passes + more
    got = Counter((r.doc_id, r.text, r.source, tuple(r.ids)) for r in pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want
