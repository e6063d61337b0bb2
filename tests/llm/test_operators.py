"""The operators against brute force, round trips and awkward inputs."""

from __future__ import annotations

import random
import re
import struct
import textwrap

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from quartermill.llm import chat_views, common, components, license_scan, line_dedup, mixing, quality_fm, sentencepiece_fst, simhash, similar_sets, token_files, transport_stream, vector_search
from quartermill.llm.common import NO_ID, splitmix

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "a line that is long enough"
WHITE = " \t\n\x0b\x0c\r"


def docs(spark, rows):
    """rows: (doc_id, text[, source])"""
    return spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows], DOCS)


def awkward(spark):
    rng = random.Random(3)
    long_text = "\n".join(" ".join(rng.choice(["alpha", "beta,", "gamma.", "é", "🙂", "x" * 70]) for _ in range(30)) for _ in range(400))
    return docs(spark, [
        (1, None, None), (2, "", "b"), (3, "  \n\t\n", "b"), (4, f"{LONG}\n{LONG.upper()}  \nshort"), (5, f"  {LONG}\nother words here, quite long"), (5, f"  {LONG}\nother words here, quite long"),
        (None, f"{LONG}\nwithout an id, long too", "c"), (None, None, None), (7, long_text, "b"), (8, long_text, "b"), (9, long_text.replace("alpha", "omega", 1), "a"), (10, "one", "a")])


# --- 1: lines -------------------------------------------------------------


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WHITE))
    place = lambda d: NO_ID if d is None else d
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(place(d))
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == place(d)]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [False, True])
def test_lines_match_brute_force(spark, heavy, monkeypatch):
    if heavy:
        monkeypatch.setattr(line_dedup, "HEAVY_LEAST", 1)
    df = awkward(spark)
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df.repartition(3)).collect()]
    assert sorted(got, key=str) == brute_lines([(r.doc_id, r.text) for r in df.collect()])


def test_lines_of_an_empty_table_and_clashing_columns(spark):
    df = awkward(spark).withColumn("n_lines", F.lit("own")).withColumn("lost_keys", F.lit(1))
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    out = line_dedup.dedup_lines(df)
    assert out.count() == df.count() and set(out.columns) == {*df.columns, "n_dropped"}


def test_perfect_hash_is_minimal():
    keys = splitmix(np.arange(5000), 9)
    at = line_dedup.PerfectHash.build(keys).index(keys)
    assert sorted(at.tolist()) == list(range(5000))
    assert line_dedup.PerfectHash.build(keys[:0]).index(keys[:3]).tolist() == [-1, -1, -1]


def test_equal_hashes_with_other_fingerprints_stay_apart():
    rows = np.array([(5, 1, 1, 1, 1), (5, 2, 2, 1, 2), (6, 1, 2, 3, 4)], line_dedup.SUM)
    index = line_dedup.LineIndex.from_bytes(line_dedup.LineIndex.build(rows).to_bytes())
    probes = np.array([(5, 1, 9), (5, 2, 2), (5, 2, 1), (6, 1, 4), (7, 1, 4)], line_dedup.PROBE)
    assert index.lost(probes).tolist() == [False, True, False, True, False]


def test_the_line_index_is_kept_in_few_files(spark, monkeypatch):
    kept, held = line_dedup.packed, []
    monkeypatch.setattr(line_dedup, "packed", lambda *a: held.append(kept(*a)) or held[-1])
    monkeypatch.setattr(common, "PACKED_BYTES", 20_000)
    rows = [(k, f"{LONG} {k // 2}\n{LONG} {k}") for k in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs(spark, rows).repartition(7)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == brute_lines(rows)
    size = sum(len(r["index"]) + len(r["top"]) for r in held[0].collect())
    assert held[0].rdd.getNumPartitions() == -(-size // 20_000) < 10
    assert held[0].count() == 28


# --- 2: SentencePiece -----------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    sentencepiece = pytest.importorskip("sentencepiece")
    path = sentencepiece_fst.model_path()
    return sentencepiece_fst.Transducer(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encoding_equals_the_library(pieces):
    own, library = pieces
    rng = random.Random(1)
    texts = ["", " ", "a", "  a", "a  b ", "\n", "\n\n a\n", "<s>", "<0x0A>", "▁", "a▁b", "\x00", "the" * 300, "梦" * 40, "é̂ x", *(" " * k for k in range(40))]
    texts += ["".join(rng.choice("aeth  \n\tx.▁éß梦😀01<s>'") for _ in range(rng.randrange(60))) for _ in range(1500)]
    for t in texts:
        want = library.encode(t)
        got = own.encode(t)
        assert got.tolist() == want, t
        assert own.decode(got) == library.decode(want), t


def test_the_path_is_the_least_of_all(pieces):
    own, _ = pieces

    def all_paths(text, at=0, before=-1):
        if at == len(text):
            yield 0.0, []
            return
        ends = [(j, own.id[text[at:j]]) for j in range(at + 1, len(text) + 1) if text[at:j] in own.id]
        if text[at : at + 1] not in own.id:
            ends.append((at + 1, -1))
        for end, piece in ends:
            for weight, rest in all_paths(text, end, piece):
                yield own.step(before, piece) + weight, [(at, end, piece), *rest]

    for text in ("▁the", "▁stating", "▁a梦b", "x", "▁▁in", "ation\n"):
        found = sorted(all_paths(text), key=lambda x: x[0])
        assert found[0][0] == 0 and (len(found) == 1 or found[1][0] == float("inf")) and own.path(text) == found[0][1]
    assert own.normalised("a b") == "▁a▁b" and own.normalised("") == ""


def test_the_search_asks_few_weights(pieces, monkeypatch):
    own, _ = pieces
    asked = []

    class Counted(dict):
        def get(self, key):
            asked.append(key)
            return super().get(key)

    monkeypatch.setattr(own, "free", Counted())
    rng = random.Random(4)
    texts = ["▁" + "".join(rng.choice(["er", "tion", "an", "hea", "st", "s", "ing", "wh", "qü", "梦", "\n"]) for _ in range(rng.randrange(1, 7))) for _ in range(800)]
    found = [own.path(t) for t in texts]
    assert own.single and len(asked) < 2 * sum(map(len, found))
    monkeypatch.setattr(own, "single", False)
    assert found == [own.path(t) for t in texts]


def test_unigram_models(tmp_path):
    sentencepiece = pytest.importorskip("sentencepiece")
    varint = lambda n: bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)
    field = lambda k, x: varint(k << 3) + varint(x) if isinstance(x, int) else varint(k << 3 | 2) + varint(len(x)) + x
    piece = lambda text, score, kind: field(1, field(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + field(3, kind))
    rng = random.Random(3)
    vocabulary = sorted({"".join(rng.choice("abc▁") for _ in range(rng.randrange(1, 5))) for _ in range(60)} | set("abc▁"))
    vocabulary = [v for v in vocabulary if "▁" not in v[1:]]
    for fallback in (True, False):
        rows = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3)] + ([piece(f"<0x{b:02X}>", 0, 6) for b in range(256)] if fallback else [])
        rows += [piece(v, -rng.randrange(1, 2000) / 128, 1) for v in vocabulary]
        model = b"".join(rows) + field(2, field(3, 1) + field(35, int(fallback))) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
        (tmp_path / "m").write_bytes(model)
        own, library = sentencepiece_fst.Transducer(str(tmp_path / "m")), sentencepiece.SentencePieceProcessor(model_proto=model)
        for _ in range(600):
            t = "".join(rng.choice("aabbcc é☃") for _ in range(rng.randrange(25)))
            assert own.encode(t).tolist() == library.encode(t), t


def test_weights_equal_the_definition(pieces):
    own, _ = pieces
    rng = random.Random(2)
    names = [p for p in own.id if "▁▁" not in p]
    for _ in range(3000):
        a, b = rng.choice(names), rng.choice(names)
        assert own.weight(a, b) == (own.merged(a + b) == [a, b]), (a, b)


def test_encode_documents(spark):
    df = awkward(spark).withColumn("ids", F.lit("clash"))
    out = sentencepiece_fst.encode_documents(df).collect()
    assert len(out) == 12 and all(r.round_trip for r in out if r.text)
    assert [r.ids for r in out if r.doc_id == 2] == [[]]
    assert sentencepiece_fst.encode_documents(df.limit(0)).count() == 0


# --- 3: token files -------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 5, 8, 11, 16, 17, 32])
def test_images_give_back_any_span(bits):
    values = np.random.default_rng(bits).integers(0, 2**bits, 9001, dtype=np.uint64).astype("<u4")
    image = token_files.Image(token_files.write_image(np.array([3, NO_ID, 9]), np.array([5000, 0, 4001]), values, bits))
    assert (image[:] == values).all() and (image[4090:8200] == values[4090:8200]).all() and len(image[7:7]) == 0
    assert (image.document(2) == values[5000:]).all() and len(image.document(1)) == 0


def test_token_files_keep_order_and_ids(spark, tmp_path, monkeypatch):
    df = awkward(spark)
    path = token_files.tokenizer_path()
    whole = token_files.encoder(path).encode_whole
    to = str(tmp_path / "f")
    token_files.images(df, file_ids=500).write.parquet(to)
    got = sorted(((r.start, r.n_tokens, r.ids_crc32, r.doc_id) for r in token_files.read_documents(spark, to).collect()), key=lambda r: r[0])
    import zlib

    at, order = 0, []
    for start, n, crc, d in got:
        assert start == at
        at += n
        order.append(-1 if d is None else d)
    assert order == sorted(order) and len(got) == 12
    want = sorted((zlib.crc32(np.array([*whole(r.text or ""), 1], "<u4").tobytes()), r.doc_id) for r in df.where("doc_id is not null").collect())
    assert sorted((c, d) for _, _, c, d in got if d is not None) == want
    files = token_files.export(spark, to, str(tmp_path / "out"))
    assert len(files) > 1 and open(files[0], "rb").read(4) == b"QMTF"


def test_splits_go_to_the_model_alone(monkeypatch):
    made = token_files.Encoder(token_files.tokenizer_path())
    rng = random.Random(6)
    words = ["".join(rng.choice(list("aBcehqtz019.,'_~<|>\x00\x1f\x7f\xa0\xad\u0130ÄßéŁ")) for _ in range(rng.randrange(1, 9))) for _ in range(4000)]
    words += [chr(k) for k in range(33, 0x180)] + ["it's", "don't'll", "x" * 300, "é" * 90]
    want = {w: [*made.encode_whole(w), 1] for w in words}
    monkeypatch.setattr(made, "encode_whole", None)
    plain = [w for w in words if max(w) < "\u0180" and "<|" not in w]
    for _ in range(2):
        assert all(np.frombuffer(made.encode(w.encode()), "<u4").tolist() == want[w] for w in plain)
    monkeypatch.undo()
    for k in range(0, len(words), 40):  # white space of other scripts too
        text = rng.choice([" ", "\n", "\u2003"]).join(words[k : k + 40])
        assert np.frombuffer(made.encode(text.encode()), "<u4").tolist() == [*made.encode_whole(text), 1]


def test_full_tables_lose_nothing():
    memo = common.Memo(3)
    memo.put_all({"a": b"1", "b": b"2"})
    memo.put_all({"c": b"3", "d": b"4"})
    assert memo.find_all({"a", "d", "x"}) == ({"a": b"1", "d": b"4"} | {"x": None}, ["x"])
    assert memo.find_all({"b", "c"})[0] == {"b": b"2", "c": b"3"}


def test_token_files_of_an_empty_table(spark, tmp_path):
    token_files.write_images(awkward(spark).limit(0), str(tmp_path / "e"))
    assert token_files.read_documents(spark, str(tmp_path / "e")).count() == 0


# --- 4: licences ----------------------------------------------------------


def test_licences(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join(rng.choice(["the", "of", "rent", "thon", "and", "ester", "work"]) for _ in range(n))
    corpus = [(k, "\n".join(noise(30) for _ in range(3))) for k in range(100, 200)]
    rows = [(1, f"{noise(20)}\nReleased under the MIT License.\n{noise(9)}"), (2, f"{noise(60)} Licensed under the Apache License, Version 2.0. {noise(60)}"), (3, "the license of the work is under version"), (4, None), (5, ""), (5, ""), (None, "Licensed under CC BY-NC 4.0."), (6, "This work is licensed under the GNU General Public License, version 3.")]
    df = docs(spark, corpus + rows)
    got = [(r.doc_id, r.licences) for r in license_scan.scan(df, license_scan.train(df)).collect()]
    assert sorted((x for x in got if x[1]), key=str) == sorted([(1, "mit"), (2, "apache-2.0"), (None, "cc-by-nc"), (6, "gpl-3.0")], key=str)
    assert len(got) == 108 and license_scan.scan(df.limit(0), license_scan.train(df.limit(0))).count() == 0


def test_notices_are_recognised():
    model = license_scan.Classifier.fit(*license_scan.training_set([b"some words of the corpus and others of it"] * 3))
    for family in license_scan.FAMILIES:
        for x in license_scan.NOTICES[family]:
            assert license_scan.confirmed(model, [x.encode()])[0][::2] == (family, True), x


def test_wrapped_and_dual_notices(spark):
    longest = {f: max(x, key=len) for f, x in license_scan.NOTICES.items()}
    rows = [(k, "some words first\n\n" + textwrap.fill(longest[f], 76, initial_indent=" * ", subsequent_indent=" * ") + "\n\nand last") for k, f in enumerate(license_scan.FAMILIES)]
    rows += [(100, "Licensed under the MIT license or the Apache License, Version 2.0."), (101, longest["gpl-2.0"] + " " + longest["mit"]), (102, longest["gpl-2.0"] + "\n" + longest["gpl-3.0"]), (103, "This work is\n\nlicensed under no\n\nterms of the License")]
    df = docs(spark, rows)
    model = license_scan.Classifier.fit(*license_scan.training_set([b"some words of the corpus and others of it"] * 3))
    got = {r.doc_id: r.licences for r in license_scan.scan(df, model).collect()}
    assert got == {**dict(enumerate(license_scan.FAMILIES)), 100: "apache-2.0,mit", 101: "gpl-2.0,mit", 102: "gpl-2.0,gpl-3.0", 103: ""}


# --- 5: quality -----------------------------------------------------------


def test_quality_learns_structure_and_takes_awkward_rows(spark):
    rng = random.Random(7)
    good = lambda: " ".join(rng.choice(["the", "rent", "of", "esther", "work."]) for _ in range(60))
    bad = lambda: " ".join(rng.choice(["the", "rent", "of", "esther"]) + rng.choice(["%%%", "###"]) for _ in range(60))
    rows = [(k, bad() if k % 4 == 0 else good()) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(0, 400)] + [(3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    df = docs(spark, rows)
    machine = quality_fm.train(df, labels)
    scored = {r.doc_id: r.quality_score for r in quality_fm.score_documents(df, machine).collect()}
    assert all((s >= 0.3) == (k % 4 != 0) for k, s in scored.items())
    odd = quality_fm.score_documents(awkward(spark).drop("n_chars").withColumn("quality_score", F.lit("x")), machine).collect()
    assert len(odd) == 12 and all(0 <= r.quality_score <= 1 for r in odd)
    assert [r.quality_score for r in quality_fm.score_documents(df.limit(3), quality_fm.train(df, labels.limit(0))).collect()] == pytest.approx([0.5] * 3)
    assert quality_fm.keep_good(df.limit(0), labels).count() == 0


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    machine = quality_fm.Machine(0.3, rng.normal(size=quality_fm.FEATURES), rng.normal(size=(quality_fm.FEATURES, 3)))
    at, x = quality_fm.features("Some words, some WORDS!! and more.\nlines".encode(), 40)
    pairs = sum(machine.v[at[i]] @ machine.v[at[j]] * x[i] * x[j] for i in range(len(at)) for j in range(i))
    assert machine.margin(at, x) == pytest.approx(0.3 + x @ machine.w[at] + pairs)


# --- 6: near copies -------------------------------------------------------


def brute_print(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    parts = [" ".join(words[k : k + width]) for k in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_fingerprints_and_components_match_brute_force(spark):
    df = awkward(spark)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    fps = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    least = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in set(root)}
    want = sorted(((rows[k][0], np.uint64(fps[k]).astype(np.int64).item(), least[root[k]]) for k in range(len(rows))), key=str)
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.near_groups(df).collect()), key=str)
    assert got == want
    assert simhash.near_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize(("blocks", "tile_rows"), [(4, 20_000), (4, 3), (8, 20_000), (2, 5), (1, 50)])
def test_links_match_all_pairs(spark, blocks, tile_rows):
    rng = np.random.default_rng(blocks)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    values = np.unique(np.concatenate([base, *[base ^ np.uint64(1) << rng.integers(0, 64, 12, dtype=np.uint64) for _ in range(12)], [np.uint64(0), np.uint64(2**64 - 1)]]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in components.components(simhash.near_pairs(df, 2, blocks, tile_rows)).collect()}
    root = list(range(len(values)))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[:i]) <= 2):
            a, b = root[i], root[j]
            root = [b if x == a else x for x in root]
    signed = values.view(np.int64).tolist()
    want, got = {}, {}
    for k, v in enumerate(signed):
        want.setdefault(root[k], set()).add(v)
        got.setdefault(roots.get(v, v), set()).add(v)
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_components_of_a_path_a_cycle_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, k) for k in range(201, 260)] + [(7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in (100, 101, 102)}, **{k: 200 for k in range(200, 260)}}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_document_of_each_group_stays(spark):
    df = awkward(spark).unionByName(docs(spark, [(None, "unlike all others without an id"), (5, "unlike the other rows of its id")])).withColumn("leader", F.lit("clash"))
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(df).collect()]
    rows = [(r.doc_id, r.text) for r in df.collect()]
    root = list(range(len(rows)))
    prints = [simhash.fingerprint((t or "").encode()) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root = [root[j] if x == root[i] else x for x in root]
    assert len(kept) == len(set(root)) and len({root[rows.index(x)] for x in kept}) == len(kept)
    for k in set(root):
        ids = [d for (d, _), x in zip(rows, root, strict=True) if x == k and d is not None]
        assert [d for x in kept if root[rows.index(x)] == k for d in [x[0]]] == [min(ids, default=None)]


def test_blocks_of_bits():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 2**64, 200_000, np.uint64), rng.integers(0, 2**64, 200_000, np.uint64)
    apart = sum(np.abs(np.bitwise_count((x >> np.uint64(16 * k)) & np.uint64(65535)).astype(int) - np.bitwise_count((y >> np.uint64(16 * k)) & np.uint64(65535))) for k in range(4))
    assert abs((apart <= 2).mean() / simhash.kept_share(4, 2) - 1) < 0.1
    assert simhash.best_blocks(1000) <= simhash.best_blocks(10**6) <= simhash.best_blocks(10**9) and simhash.best_blocks(10**9) >= 8


def brute_groups(rows):
    """Group numbers by all pairs; rows are texts."""
    sets = []
    for t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    return root


@pytest.mark.parametrize("pairs", [64, 0])
def test_pipeline_finds_near_copies_like_brute_force(spark, pairs, monkeypatch):
    monkeypatch.setattr(similar_sets, "PAIRS", pairs)
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    rows, passage = [], text(60)
    for base in (text(n) for n in (6, 12, 40, 90, 150, 400)):
        rows.append(" ".join(base))
        for n in range(14):
            words = list(base)
            for _ in range(n % 7 * len(base) // 120 + 1):
                words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
            rows.append(" ".join(words))
    rows += [" ".join(text(20) + passage + text(rng.randrange(60))) for _ in range(40)]
    df = docs(spark, [(k, t) for k, t in enumerate(rows)]).unionByName(awkward(spark).where("doc_id is null or doc_id > 0").withColumn("doc_id", F.col("doc_id") + 1000))
    rows = [(r.doc_id, r.text) for r in df.collect()]
    root = brute_groups([t for _, t in rows])
    least = {}
    for (d, _), r in zip(rows, root, strict=True):
        least.setdefault(r, []).append(NO_ID if d is None else d)
    got = corpus_pipeline.near_copies(spark, df.repartition(5), "").collect()
    assert sorted(NO_ID if r.doc_id is None else r.doc_id for r in got) == sorted(map(min, least.values()))
    prints = {d: brute_print(t, 3) for d, t in rows}
    assert any(bin(prints[a] ^ prints[b]).count("1") > 2 for m in least.values() for a, b in zip(m, m[1:], strict=False) if NO_ID not in (a, b))
    assert corpus_pipeline.near_copies(spark, df.limit(0), "").count() == 0


def test_pipeline_finds_near_copies_by_simhash(spark, monkeypatch):
    """Without the exact way for what the radius leaves out, just the pairs of SimHash tiles that pass the exact check are linked."""
    monkeypatch.setattr(similar_sets, "_first_round", lambda batches: (b for b in () if sum(x.num_rows for x in batches)))
    rng = random.Random(21)
    rows = []
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(200)]
        near = [*base[:-1], f"x{rng.randrange(9999)}"]
        rows += [" ".join(base), "  ".join(base).upper().replace("W", "w"), " ".join(near), " ".join(near[:150] + [f"y{rng.randrange(9999)}" for _ in range(50)])]
    parts = [[tuple(w[k : k + 5]) for k in range(len(w) - 4)] for w in (t.split() for t in rows)]
    prints = [brute_print(" ".join(t.split()), 5) for t in rows]
    root, near = list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            a, b = set(parts[i]), set(parts[j])
            if bin(prints[i] ^ prints[j]).count("1") <= similar_sets.RADIUS and 5 * len(a & b) >= 4 * len(a | b):
                near += a != b
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    assert near > 3 and len(set(root)) > 30
    got = corpus_pipeline.near_copies(spark, docs(spark, list(enumerate(rows))).repartition(5), "").collect()
    assert sorted(r.doc_id for r in got) == sorted({r: k for k, r in reversed(list(enumerate(root)))}.values())


# --- 7: transport streams -------------------------------------------------


@pytest.mark.parametrize("units", [1, 2, 31, 32, 33, 64, 257])
def test_streams_give_back_their_payload(units):
    payload = random.Random(units).randbytes(576 * units)
    stream = transport_stream.store(payload)
    media = transport_stream.load(stream)
    found = media.streams[transport_stream.STREAM_PID]
    assert found.samples == payload and media.errors == 0 and media.programs == {1: 0x1000} and len(stream) % 188 == 0
    assert found.stamps == [k * 32 * transport_stream.TICKS for k in range(-(-units // 32))]
    assert [p for p, _ in found.points] == found.stamps[::8]


def test_damaged_streams():
    payload = random.Random(1).randbytes(576 * 100)
    s = transport_stream.store(payload)
    repeated = transport_stream.load(s[: 188 * 10] + s[188 * 9 :])
    assert repeated.streams[256].repeats == 1 and repeated.streams[256].samples == payload and repeated.errors == 0
    lost = transport_stream.load(s[: 188 * 10] + s[188 * 11 :])
    assert lost.streams[256].gaps == 1 and lost.streams[256].broken == 1 and payload.endswith(lost.streams[256].samples)
    assert transport_stream.load(b"\0" + s[1:]).damaged == 1 and transport_stream.load(b"").streams == {}
    table = bytearray(s)
    table[10] ^= 1  # a program table whose CRC fails
    assert transport_stream.load(bytes(table)).errors == 1


def test_media_columns(spark):
    rows = transport_stream.store_media(awkward(spark)).collect()
    for r, t in zip(rows, awkward(spark).collect(), strict=True):
        data = (t.text or "").encode()
        got = transport_stream.load(bytes(r.media)).streams[256].samples
        assert got[: r.n_bytes] == data and set(got[r.n_bytes :]) <= {255} and len(got) % 576 == 0 and len(got) > 0
        assert r.points[0]["pts"] == 0
    assert transport_stream.store_media(awkward(spark).limit(0)).count() == 0


# --- 8: vectors -----------------------------------------------------------


def test_search_takes_part_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=6).astype("float32").tolist()) for k in range(300)]
    rows += [(k, rows[50][1]) for k in range(1000, 1200)] + [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [1.0] * 5), (None, [1.0] * 6), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = vector_search.nearest(df, F.col("vec_id") % 50 == 0, k=5, rerank=40, candidates=64)
    by = {}
    for r in got.collect():
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [v for _, v, _ in sorted(by[50])] == [1000, 1001, 1002, 1003, 1004] and [v for _, v, _ in sorted(by[1000])] == [50, 1001, 1002, 1003, 1004]
    assert 300 not in by and all(len(x) == 5 and [r for r, _, _ in sorted(x)] == [1, 2, 3, 4, 5] for x in by.values())
    clean = spark.createDataFrame([r for r in rows if r[0] is not None and r[0] != 304 and r[0] != 0], "vec_id bigint, embedding array<float>")
    assert vector_search.recall(vector_search.nearest(clean, F.col("vec_id") % 50 == 0), clean, F.col("vec_id") % 50 == 0) >= 0.9
    few = vector_search.nearest(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert vector_search.nearest(df.where("vec_id = 300"), F.col("vec_id") % 50 == 0).count() == 0
    # the odd length, at the smallest id too, doesn't take the others out
    odd = df.union(spark.createDataFrame([(-5, [1.0])], df.schema))
    assert sorted(map(str, vector_search.nearest(odd, F.col("vec_id") % 50 == 0, k=5, rerank=40, candidates=64).collect())) == sorted(map(str, got.collect()))
    huge = spark.createDataFrame([(0, [1e200, 2e200]), (1, [1e-200, 2e-200]), (2, [2.0, -1.0]), (3, [3e-200, 1e-200])], "vec_id bigint, embedding array<double>")
    assert [(r.vec_id, round(r.score, 9)) for r in vector_search.nearest(huge, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1.0), (3, round(5 / 50**0.5, 9)), (2, 0.0)]


def test_cells_keep_recall(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "CELL_ROWS", 100)
    rng = np.random.default_rng(9)
    middles = rng.normal(size=(25, 16))
    rows = [(k, (middles[k % 25] + 0.4 * rng.normal(size=16)).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    data = vector_search.unit(np.array([v for _, v in rows]))
    index = vector_search.Index.fit(data, len(data), 5)
    assert len(index.centres) == 30 and index.visits.shape[1] < 20
    got = vector_search.nearest(df, F.col("vec_id") % 50 == 0, candidates=50, group=2)
    assert vector_search.recall(got, df, F.col("vec_id") % 50 == 0) >= 0.95
    for r in got.collect()[:50]:
        assert abs(r.score - float(data[r.query_id] @ data[r.vec_id])) < 1e-12


def test_quantiser_weighs_the_parallel_residual():
    x = vector_search.unit(np.random.default_rng(2).normal(size=(2000, 64)))
    made = vector_search.Quantiser.fit(x)
    codes = made.codes(x)
    back = made.centres[np.arange(32)[None], codes].reshape(2000, 64)
    r = x - back
    along = (r * x).sum(1)
    plain = vector_search.Quantiser(made.centres, 1.0)
    other = plain.centres[np.arange(32)[None], plain.codes(x)].reshape(2000, 64)
    assert (along**2).mean() < (((x - other) * x).sum(1) ** 2).mean()
    look = made.tables(x[0])
    packed = made.packed(x)
    assert np.allclose(look[np.arange(len(look))[None], packed].sum(1), back @ x[0], atol=1e-4)


# --- 9: chats -------------------------------------------------------------


def test_every_participant_gets_its_own_view(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "é!"), (2, 0, "system", "alone"), (None, None, "zoe", ""), (1, 600, "ann", "later"), (1, 601, "a\nb", "x"), (1, None, "ann", "loose"), (1, 1200, "bob", "last")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("speaker", F.lit(1)).withColumn("at", F.lit("clash"))
    got = chat_views.rotate(df).collect()
    views = {(r.conv_id, r.speaker): [] for r in got}
    for r in sorted(got, key=lambda r: r.part):
        views[r.conv_id, r.speaker].append(r)
    assert set(views) == {(1, s) for s in ("ann", "bob", "unknown", "a b")} | {(None, "zoe")}
    # brute force: the whole rendering in one piece
    said = [(r[2] or "unknown", (r[3] or "").replace("<|", "< |")) for r in sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "unknown"))]
    for speaker in ("ann", "bob", "unknown", "a b"):
        whole, spans = "", []
        for role, text in said:
            role = role.replace("\n", " ")
            whole += "<|im_start|>" + ("assistant" if role == speaker else role if role == "system" else f"user name={role}") + "\n"
            spans += [(len(whole), len(whole) + len(text) + 11)] if role == speaker else []
            whole += text + "<|im_end|>\n"
        parts = views[1, speaker]
        assert "".join(r.text for r in parts) == whole and len(parts) == 4
        assert [(m.start, m.end) for r in parts for m in r["mask"]] == spans
        assert all(whole[r["at"] :].startswith(r.text) for r in parts) and sum(r.n_turns for r in parts) == len(said)
    assert chat_views.rotate(df.limit(0)).count() == 0


# --- 10: mixing -----------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutations(n):
    a, b = mixing.permuted(np.arange(n), n, 1), mixing.permuted(np.arange(n), n, 2)
    assert sorted(a.tolist()) == sorted(b.tolist()) == list(range(n)) and (n < 10 or (a != b).any())


def test_shards_share_out_all_slots():
    counts = (100, 50, 7, 0, 33)
    at, shards = np.zeros(5, int), -(-sum(counts) // 10)
    for k in range(shards):
        start, got = mixing.shard_counts(counts, shards, 10, k)
        assert start == at.tolist() and sum(got) == min(10, sum(counts) - 10 * k)
        at += np.array(got)
    assert at.tolist() == list(counts)


def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([10, 1000, 0, 1000], [5, 2, 1, 5]) == [30.0, pytest.approx(1980 * 2 / 7), 0.0, pytest.approx(1980 * 5 / 7)]


def test_large_draws_follow_the_same_law():
    rng = np.random.default_rng(5)
    u = rng.random(4000)
    ours = np.array([mixing.inverted(3000, 5000, 2000, float(x)) for x in u])
    theirs = np.random.default_rng(6).hypergeometric(3000, 5000, 2000, 4000)
    assert abs(ours.mean() - theirs.mean()) < 1.5 and abs(ours.std() / theirs.std() - 1) < 0.05
    assert mixing.inverted(3, 2, 5, 0.5) == 3 and mixing.inverted(10, 0, 4, 0.999) == 4 and mixing.inverted(0, 10, 4, 0.1) == 0
    big = mixing.hypergeometric(4 * 10**11, 6 * 10**11, 5 * 10**11, rng)
    assert abs(big - 2 * 10**11) < 10 * 350_000
    start, got = mixing.shard_counts((6 * 10**9, 4 * 10**9), 10**10 // 4096 + 1, 4096, 1_000_000)
    assert sum(got) == 4096 and sum(start) == 4096 * 1_000_000 and 1000 < got[1] < 2300


def mix_rows():
    rng = random.Random(11)
    rows = [(k, " ".join(rng.choice(["a", "bb", "ccc"]) for _ in range(rng.randrange(1, 400))), f"s{k % 4}") for k in range(400)]
    more = [(900, None, None), (901, "one two three", None), (902, "", "s1"), (None, "x y", "s1"), (None, "x", "s1"), (3, "same id again", "s3"), (3, None, "s3")]
    return rows + more + [(7, "equal rows that say the same", "s3")] * 5


def brute_mix(mix):
    """(doc_id, mark, copy) -> [(shard, slot, first, n)], by laying out every word of every source."""
    held, at = {}, {}
    for r in mix.placed.collect():
        for c in range(r.copies):
            for w in range(r["size"]):
                place = r.start + c * r["size"] + w
                assert (r.src, place) not in held
                held[r.src, place] = (r.doc_id, r.mark, c, w)
    for src, n in enumerate(mix.sizes):
        assert all((src, k) in held for k in range(n))
    out, blocks = {}, [-(-n // mix.block) for n in mix.sizes]
    for shard in range(mix.shards):
        start, got = mixing.shard_counts(mix.slots, mix.shards, mix.shard_slots, shard, mix.seed)
        dealt = []
        for src, (a, g) in enumerate(zip(start, got, strict=True)):
            for j in range(a, a + g):
                p = j // blocks[src]
                dealt.append((src, int(mixing.permuted(np.array([j % blocks[src]]), blocks[src], mix.seed + 1009 * src + 7919 * p)[0])))
        for slot, k in enumerate(np.random.default_rng([mix.seed, 1, shard]).permutation(len(dealt)).tolist()):
            src, block = dealt[k]
            for place in range(block * mix.block, min((block + 1) * mix.block, mix.sizes[src])):
                d, m, c, w = held[src, place]
                out.setdefault((d, m, c), []).append((shard, slot, w))
                at[shard, slot] = src
    return out


def test_mix(spark):
    rows = mix_rows()
    df = docs(spark, rows).withColumn("slot", F.lit("clash"))
    mix = mixing.Mix(df, shard_slots=50)
    got = mix.taken().collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert sorted((r.doc_id or -1, r["size"]) for r in got) == sorted((d or -1, len((t or "").split())) for d, t, _ in rows)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(t - n) <= max(64, 0.02 * t) for t, n in by.values())
    again = mixing.Mix(df.repartition(5), shard_slots=50).taken().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    brute = brute_mix(mix)
    expected = sorted((d if d is not None else -1, len(x), len({y[:2] for y in x}), min(y[0] for y in x)) for (d, _, _), x in brute.items())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.taken, r.n_slots, r.first_shard) for r in got if r.taken) == expected
    other = mixing.Mix(df, shard_slots=50, seed=1).taken().collect()
    assert sorted(str(r.slots_hash) for r in other) != sorted(str(r.slots_hash) for r in got)
    assert mixing.Mix(df.limit(0)).taken().count() == 0 and mixing.mix_documents(df.limit(0)).count() == 0


def test_mixed_texts_are_the_slots_words(spark):
    rows = mix_rows()
    for some in (rows, rows[:400]):  # with and without equal rows
        df = docs(spark, some)
        mix = mixing.Mix(df, shard_slots=50)
        out = mixing.mixed(df, mix)
        parts = [r for p in out.withColumn("p", F.spark_partition_id()).collect() for r in [p]]
        texts = {spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0]: t for t in {t for _, t, _ in some[400:]}} if len(some) > 400 else {}
        texts |= {m: t for m, t in df.select(F.xxhash64("text"), "text").collect()}
        expected = sorted((shard, slot, w, texts[m].split()[w]) for (_, m, _), x in brute_mix(mix).items() for shard, slot, w in x)
        assert sorted((r.shard, r.slot, r.first_word + k, w) for r in parts for k, w in enumerate(r.text.split())) == expected
        assert all(r.n_chars == len(r.text) for r in parts)
        assert len({(r.shard, r.p) for r in parts}) == len({r.shard for r in parts})  # a shard lies in one partition
        for p in {r.p for r in parts}:
            own = [(r.shard, r.slot, r.first_word) for r in parts if r.p == p]
            assert own == sorted(own)
        assert mixing.mix_documents(df, mix).columns == df.columns


def test_pieces_keep_the_texts_own_white_space():
    text = b" a  b\nc d\te"
    assert mixing.pieces(text, 5, [(0, 5), (0, 2), (4, 1)]) == [text, b"a  b", b"e"]
    assert mixing.pieces(text, 5, [(1, 3)]) == [b"b\nc d"]


def test_narrow_checkpoints_make_few_files(spark, monkeypatch):
    """Files follow the rows, not the partitions; where rows are many, as many tasks write them."""
    monkeypatch.setattr(common, "PACKED", 100)
    for n, files in ((0, 1), (90, 1), (350, 4)):
        kept = common.packed(spark.range(0, n, 1, 60))
        assert kept.rdd.getNumPartitions() == files and [r.id for r in kept.orderBy("id").collect()] == list(range(n))
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint").repartition(50)
    written = []
    roots = components.components(edges, keep=lambda df: written.append(common.packed(df)) or written[-1])
    assert {(r.node, r.root) for r in roots.collect()} == {(k, 0) for k in range(41)}
    assert all(df.rdd.getNumPartitions() == 1 for df in written)


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(12)
    for n, m in ((0, 1), (5, 300), (3000, 3100), (3000, 40_000)):
        shared = rng.integers(0, 2**64, min(n, m) // 2, np.uint64)
        x, y = (np.unique(np.concatenate([shared, rng.integers(0, 2**64, k - len(shared), np.uint64)])) for k in (n, m))
        differ = len(np.setxor1d(x, y))
        found = similar_sets.apart(similar_sets.wide_sketch(x), similar_sets.wide_sketch(y))
        assert found <= differ and (max(n, m) > 2 * min(n, m) or found >= 0.7 * differ)
    assert similar_sets.apart(similar_sets.wide_sketch(x), similar_sets.wide_sketch(x)) == 0
