"""Operators against brute force, on small fixtures with the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import bpe, contextual_pii, host_reputation, interleave, line_crf, mixing, progressive_jpeg, simhash_pivot, site_quality, substring_dedup

WORDS = re.compile("[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sample() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    passage = " ".join(f"p{k}" for k in range(70))
    out = []
    for i in range(80):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 120)))
        if i % 5 == 0:
            text += "\n" + passage + " tail"
        if i % 7 == 0:
            text += f" mail a{i}@mail.example.com now +1 (555) 000-{1000 + i} and 10.0.0.{i} or 4111 1111 1111 1111 x"
        out.append((i, text, "en", None if i % 9 == 0 else f"src{i % 3}", len(text)))
    out += [(100, None, None, None, None), (101, "", "en", "src0", 0), (102, out[1][1], "en", "src1", 1), (103, passage + " " + passage, "de", "hot", 1), (104, "Zwölf 😀 日本 Größe\u00a0x", "de", "hot", 3), (105, "9" * 3000, "en", "src1", 1), (106, "a.b " * 4000, "en", "src2", 1)]
    return out


@pytest.fixture(scope="module")
def rows():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORDS.findall(text or "")


def test_substring_dedup(docs, rows, empty):
    seen, want = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            key = tuple(w[p : p + 20])
            if key in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_substrings(docs, digest=True).collect()} == want
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_substring_dedup_in_two_levels(spark, docs, monkeypatch):
    """As many buckets as a huge input has, each chunk cut into few: the same result."""
    monkeypatch.setattr(substring_dedup, "CHUNK", 3000)
    want = sorted(map(tuple, substring_dedup.dedup_substrings(docs, digest=True).collect()), key=str)
    monkeypatch.setattr(substring_dedup, "PER_BUCKET", 50)
    monkeypatch.setattr(substring_dedup, "FANOUT", 8)
    monkeypatch.setattr(substring_dedup, "GATHER", 20_000)
    assert sorted(map(tuple, substring_dedup.dedup_substrings(docs, digest=True).collect()), key=str) == want


def test_bytes_of_a_window_do_not_depend_on_the_buckets():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, 400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_key", "text"])
    size = {n: sum(len(b) for out in substring_dedup._probe(n)([batch]) for b in out.column(1).to_pylist()) / (1500 * 391) for n in (24, 2400)}
    assert size[24] < 8 and size[2400] < 1.1 * size[24]


def test_substring_dedup_of_repeated_rows(spark):
    text = " ".join(f"q{k}" for k in range(30))
    df = spark.createDataFrame([(1, text), (1, text), (2, text), (None, "x")], "doc_id long, text string")
    assert sorted(r.n_removed for r in substring_dedup.dedup_substrings(df).collect()) == [0, 0, 0, 30]


def test_substring_dedup_of_texts_that_share_an_id(spark):
    line = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    long = line("z", 300) + " " + line("p", 40)
    data = [(1, line("p", 40)), (1, long), (9, "short " + line("y", 25)), (9, long + " end"), (None, "x y"), (None, line("y", 25)), (None, line("p", 40) + " z")]
    got = {(r.n_words, r.n_removed) for r in substring_dedup.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string").coalesce(1)).collect()}
    order = sorted(data, key=lambda r: (substring_dedup.NULL_ID if r[0] is None else r[0], substring_dedup.text_key(r[1].encode())))
    seen, want = set(), set()
    for _, text in order:
        w = words(text)
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            if (key := tuple(w[p : p + 20])) in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(key)
        want.add((len(w), sum(gone)))
    assert got == want


def test_line_rules(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in line_crf.quality_rules(docs, line_crf.trained_field(docs, labels)).collect()}
    for i, text, *_ in rows:
        w, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
        starts = defaultdict(list)
        for p in range(len(w) - 7):
            starts[tuple(w[p : p + 8])].append(p)
        repeated = {q for ps in starts.values() if len(ps) > 1 for p in ps for q in range(p, p + 8)}
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w)) and not (r.base_failed and r.kept)
    assert line_crf.quality_rules(empty, line_crf.LineField()).count() == 0


def test_viterbi_is_exact():
    rng = np.random.default_rng(1)
    field = line_crf.LineField(rng.normal(size=(len(line_crf.FEATURES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    for _ in range(50):
        scores = rng.normal(size=(rng.integers(1, 8), 2))
        value = lambda path: field.start[path[0]] + sum(scores[i][s] for i, s in enumerate(path)) + sum(field.step[a][b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(value([n >> i & 1 for i in range(len(scores))]) for n in range(1 << len(scores)))
        assert abs(value(field.viterbi(scores.tolist())) - best) < 1e-9


def test_field_learns():
    good, bad = [(0, 2, 11)] * 3, [(0, 2, 5)] * 3
    field = line_crf.LineField()
    field.train([good, bad] * 20, [[1] * 3, [0] * 3] * 20)
    assert field.viterbi(field.scores(good).tolist()) == [1] * 3 and field.viterbi(field.scores(bad).tolist()) == [0] * 3


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(6)
    draw = lambda: (rng.normal(size=(len(line_crf.FEATURES), 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    params, texts = draw(), [[tuple(rng.choice(len(line_crf.FEATURES), 3, replace=False).tolist()) for _ in range(n)] for n in (1, 4, 3, 2)]
    states = [rng.integers(0, 2, len(t)).tolist() for t in texts]

    def likelihood(parts):
        emit, step, start = parts
        out = 0.0
        for t, gold in zip(texts, states):
            e = [emit[list(f)].sum(0) for f in t]
            value = lambda path: start[path[0]] + sum(e[i][s] for i, s in enumerate(path)) + sum(step[a][b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
            out += value(gold) - np.log(sum(np.exp(value([n >> i & 1 for i in range(len(t))])) for n in range(1 << len(t))))
        return out

    field = line_crf.LineField(*params)
    grads = [sum(g) for g in zip(*(field._gradient(b) for b in line_crf._batches(texts, states)))]
    for _ in range(10):
        move = draw()
        up, down = (likelihood([p + sign * 1e-5 * m for p, m in zip(params, move)]) for sign in (1, -1))
        assert abs((up - down) / 2e-5 - sum((g * m).sum() for g, m in zip(grads, move))) < 1e-4


def test_long_chains_are_trained_whole(monkeypatch):
    texts = [[(0, 2)] * 20 + [(0, 5)] * 20] * 10
    field = line_crf.LineField()
    field.train(texts, [[1] * 20 + [0] * 20] * 10)
    monkeypatch.setattr(line_crf, "PIECE", 16)
    pieces = line_crf.LineField()
    pieces.train(texts, [[1] * 20 + [0] * 20] * 10)
    assert sum(b.live.sum() for b in line_crf._batches(texts, [[1] * 40] * 10)) == 400  # no line is left out
    for f in (field, pieces):
        assert f.viterbi(f.scores(texts[0]).tolist()) == [1] * 20 + [0] * 20


def test_lines_of_mixed_documents_held_out(spark, sf_dir):
    """Trained on two thirds of the labels; stretches of held-out bad documents inside held-out good ones are found."""
    docs, labels = spark.read.parquet(f"{sf_dir}/../sf0.1/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.1/labels.parquet")
    field = line_crf.trained_field(docs, labels.where("doc_id % 3 > 0"))
    held = docs.join(labels.where("doc_id % 3 = 0"), "doc_id").orderBy("doc_id").collect()
    good = [r.text for r in held if r.quality == 1 and not r.toxic and r.text.count("\n") > 3]
    bad = [r.text for r in held if r.quality == 0]
    often = Counter(line for r in docs.collect() for line in set((r.text or "").split("\n")))  # may be headers and footers: not judged
    right = total = both = 0
    license_ = "This work is licensed under the GNU General Public License, version 3."
    for k, text in enumerate(good):
        lines, junk = text.split("\n"), [*bad[k % len(bad)].split("\n")[:3], license_]
        at = k % len(lines)
        mixed = lines[:at] + junk + lines[at:]
        want = [1] * at + [0] * len(junk) + [1] * (len(lines) - at)
        want = [None if often[line] > 2 and line != license_ else w for w, line in zip(want, mixed) if line.split()]
        got = field.viterbi(field.scores(line_crf.text_lines("\n".join(mixed).encode())[0]).tolist())
        right, total = right + sum(a == b for a, b in zip(got, want)), total + len(want) - want.count(None)
        both += 0 < sum(got) < len(got)
    assert right >= 0.95 * total and both >= 0.9 * len(good)


def test_kept_is_the_content_share_of_the_best_path(spark):
    rng = random.Random(4)
    parts = [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(2, 20))) for _ in range(12)]
    junk = ["BUY!! NOW!!", "a | b | c | d", "x### y$$$ z%%%", "All rights reserved.", "12 34 56 78"]
    data = [(k, "\n".join(rng.choice(parts + junk) for _ in range(rng.randrange(1, 9)))) for k in range(60)] + [(100, "one " * 30 + "\n" + "b" * 200_000), (101, None), (102, " \n\t\n")]
    gen = np.random.default_rng(2)
    field = line_crf.LineField(gen.normal(size=(len(line_crf.FEATURES), 2)), gen.normal(size=(2, 2)), gen.normal(size=2))
    out = {r.doc_id: r for r in line_crf.quality_rules(spark.createDataFrame(data, "doc_id long, text string"), field).collect()}
    for i, text in data:
        lines = [x for x in (text or "").split("\n") if words(x)]
        if not lines:
            assert not out[i].kept and out[i].n_lines == out[i].content_lines == 0
            continue
        scores = field.scores(line_crf.text_lines(text.encode())[0])
        value = lambda path: field.start[path[0]] + sum(scores[j][s] for j, s in enumerate(path)) + sum(field.step[a][b] for a, b in zip(path, path[1:]))  # noqa: B023, E731
        best = max(([n >> j & 1 for j in range(len(lines))] for n in range(1 << len(lines))), key=value)
        share = sum(len(x.encode()) for x, s in zip(lines, best) if s) / sum(len(x.encode()) for x in lines)
        assert abs(out[i].content_share - share) < 1e-9 and out[i].kept == (not out[i].base_failed and share >= line_crf.MIN_CONTENT)
    none = line_crf.trained_field(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert (none.emit == line_crf.LineField().emit).all()


def test_bpe_as_the_library_does(docs, rows, empty):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    reference, mine = tokenizers.Tokenizer.from_file(path), bpe.ByteBPE(path)
    rng = random.Random(2)
    letters = [*map(chr, range(0x180)), *" \t\n\r\x0b\x1c\x85\u00a0\u2003'", "<|endoftext|>", "日", "😀", "the", "ing", "\u0301"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + [r[1] or "" for r in rows] + ["a" * 5000, "  x  y ", "\n \n"]
    for t in texts:
        ids = reference.encode(t, add_special_tokens=False).ids
        assert mine.encode(t) == ids and mine.decode(ids) == reference.decode(ids, skip_special_tokens=False)
    got = {r.doc_id: r for r in bpe.token_digests(docs, path).collect()}
    for i, t, *_ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    out = bpe.encode_documents(docs.withColumn("n_tokens", docs.doc_id), path)
    assert out.columns == [*docs.columns, "token_ids", "n_tokens"] and bpe.encode_documents(empty, path).count() == 0


def test_site_quality_held_out(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet")
    docs, labels = read("documents"), read("labels")
    model = site_quality.fit_text_model(docs, site_quality.bad_labels(labels).where("doc_id % 3 > 0"))
    held = site_quality.rated(docs, model, site_quality.page_sites(read("pages"))).join(labels, "doc_id").where("doc_id % 3 = 0").collect()
    clean, junk = [r for r in held if r.quality == 1 and not r.toxic], [r for r in held if r.quality == 0]
    assert all(r.keep for r in clean) and sum(not r.keep for r in junk) >= 0.9 * len(junk)


SITES = "doc_id long, host string, path string"


def test_site_quality_edges(spark, docs, rows, empty):
    none = spark.createDataFrame([], SITES)
    labels = spark.createDataFrame([], "doc_id long, bad int")
    model = site_quality.fit_text_model(docs, labels)
    assert not model.words and site_quality.rated(docs, model, none).where("keep").count() == docs.count()
    assert site_quality.rated(empty, model, none).count() == 0 and site_quality.rated(empty, model, spark.createDataFrame([(1, "h", "p")], SITES)).count() == 0
    assert not site_quality.fit_text_model(docs, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, bad int")).words  # one kind only
    odd = spark.createDataFrame([(None, None, 1, 2), (None, "x", 3, 4), (5, None, 5, 6), (5, None, 5, 6)], "doc_id long, `te.xt` string, own_id int, `site.p` int")
    kept = site_quality.keep_good(odd, labels, spark.createDataFrame([(5, None, "p"), (None, "h", "p"), (5, "h", None)], SITES), text="te.xt")
    assert kept.columns == odd.columns and kept.count() == 4


def test_site_quality_learns_from_whole_texts(spark):
    long = " ".join(f"a{k}" for k in range(5000))
    df = spark.createDataFrame([(k, long + (" zzz" if k % 2 else "")) for k in range(40)], "doc_id long, text string")
    model = site_quality.fit_text_model(df, spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, bad int"))
    assert b"zzz" in model.words


def test_posteriors_by_brute_force(spark):
    """Where sites differ they decide: the same text is kept on a good host and rejected on a bad one."""
    rng = random.Random(7)
    model = site_quality.TextModel([-1.0, *[0.0] * (site_quality.STATS - 1)], {b"bad": 3.0})
    homes = [("good.org", "a"), ("good.org", None), ("bad.org", "a"), ("bad.org", "b"), ("one.org", "a"), (None, None)]
    data, sites = [], []
    for k in range(400):
        host, path = homes[k % 5] if k % 7 else homes[5]
        worse = {"good.org": 0.05, "bad.org": 0.8 if path == "a" else 0.5}.get(host, 0.3)
        data.append((k, "text bad" if rng.random() < worse else f"text {k}"))
        if host:
            sites += [(k, host, path), (k, "zzz.org", "later")]
    out = site_quality.rated(spark.createDataFrame(data, "doc_id long, text string").repartition(3), model, spark.createDataFrame(sites, SITES)).collect()
    home = {k: homes[k % 5] if k % 7 else homes[5] for k in range(400)}
    p = {k: 1 / (1 + np.exp(-model.logit(t))) for k, t in data}
    n, total = len(p), sum(p.values())

    def strength(parent_of, child_of):
        groups = defaultdict(lambda: defaultdict(list))
        for k in p:
            if home[k][0]:
                groups[parent_of(k)][child_of(k)].append(p[k])
        children = [(g, np.array(v)) for g, c in groups.items() for v in c.values()]
        pooled = {g: np.concatenate(list(c.values())).mean() for g, c in groups.items()}
        size = sum(len(v) for _, v in children)
        b = sum(len(v) * (v.mean() - pooled[g]) ** 2 for g, v in children) / (len(children) - len(groups))
        w = sum(((v - v.mean()) ** 2).sum() for _, v in children) / (size - len(children))
        n0 = (size - sum(sum(len(v) ** 2 for v in c.values()) / sum(map(len, c.values())) for c in groups.values())) / (len(children) - len(groups))
        return 1 / min(max((b - w) / (b + (n0 - 1) * w), 0.0001), 0.5) - 1

    host_k, path_k = strength(lambda k: 0, lambda k: home[k][0]), strength(lambda k: home[k][0], lambda k: home[k])
    for r in out:
        k = r.doc_id
        base = rate = (total - p[k] + 0.5) / n
        if home[k][0]:
            same, here = [j for j in p if home[j][0] == home[k][0]], [j for j in p if home[j] == home[k]]
            rate = (sum(p[j] for j in same) - p[k] + host_k * base) / (len(same) - 1 + host_k)
            rate = (sum(p[j] for j in here) - p[k] + path_k * rate) / (len(here) - 1 + path_k)
        odds = p[k] / (1 - p[k]) * rate / (1 - rate) * (1 - base) / base
        assert abs(r.site - rate) < 1e-9 and abs(r.posterior - odds / (1 + odds)) < 1e-9 and r.keep == (r.posterior <= site_quality.REJECT_ABOVE)
    plain = {r.host: r.keep for r in out if r.p < 0.3}
    assert plain["good.org"] and not plain["bad.org"] and plain[None]


def test_strengths_follow_the_spread(spark):
    rng = np.random.default_rng(5)
    from plumbline.llm import shrinkage

    for k, low, high in ((4, 2, 8), (100, 50, 400)):
        rows = []
        for _ in range(400):
            n = int(rng.integers(20, 60))
            s = int(rng.binomial(n, rng.beta(0.3 * k, 0.7 * k)))
            rows.append((1, "", n, float(s), float(s)))
        found = shrinkage.strengths(spark.createDataFrame(rows, "level int, parent string, n long, s double, q double"))
        assert low < found[1] < high
    assert shrinkage.strengths(spark.createDataFrame([], "level int, parent string, n long, s double, q double")) == {}
    assert shrinkage.strength(0, 0, 0, 0, 0) == 1 / shrinkage.RHO[0] - 1


def test_jpeg_round_trip(docs, rows, empty):
    got = {r.doc_id: r for r in progressive_jpeg.media_digests(docs).collect()}
    for i, t, *_ in rows:
        data = (t or "").encode()
        p = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    assert got[100].feature == got[101].feature and got[1].media_sha256 == got[102].media_sha256
    media = progressive_jpeg.decode_media(progressive_jpeg.pack_texts(docs.limit(3)))
    assert all(len(r.tensor) == r.height * r.width * 3 for r in media.collect()) and progressive_jpeg.media_digests(empty).count() == 0


def test_jpeg_bit_reader_agrees(monkeypatch):
    media = progressive_jpeg.pack(progressive_jpeg.padded(bytes(range(256)) * 5 + b"\xff" * 300))
    fast = progressive_jpeg.Progressive(media)
    monkeypatch.setattr(progressive_jpeg.Progressive, "even", lambda *a: False)
    slow = progressive_jpeg.Progressive(media)
    assert slow.payload() == fast.payload() and all((a.coef == b.coef).all() for a, b in zip(fast.comps, slow.comps))


def read_progressive(data):
    """A plain reader of progressive files, one bit after another; shares nothing with the operator's.
    Returns height, width and, for each component, its sampling and blocks (8 x 8 coefficients in natural order)."""
    natural = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    trees, frame, restart, at = {}, None, 0, 2
    while data[at + 1] != 0xD9:
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xC4:
            while body:
                code, symbols, tree = 0, iter(body[17:]), {}
                for length in range(1, 17):
                    for _ in range(body[length]):
                        tree[f"{code:0{length}b}"] = next(symbols)
                        code += 1
                    code <<= 1
                trees[body[0]], body = tree, body[17 + sum(body[1:17]) :]
        elif kind == 0xDD:
            restart = int.from_bytes(body, "big")
        elif kind == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = [(body[k + 1] >> 4, body[k + 1] & 15, defaultdict(lambda: [0] * 64)) for k in range(6, len(body), 3)]
            most_h, most_v = max(f[0] for f in frame), max(f[1] for f in frame)
        elif kind == 0xDA:
            parts = [(frame[body[1 + 2 * k] - 1], body[2 + 2 * k]) for k in range(body[0])]
            low, high, ah, al = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            end = at
            while not (data[end] == 0xFF and data[end + 1] != 0 and not 0xD0 <= data[end + 1] <= 0xD7):
                end += 1
            runs, part, k = [], bytearray(), at
            while k < end:
                if data[k] == 0xFF:
                    if data[k + 1]:
                        runs.append(part)
                        part = bytearray()
                    else:
                        part.append(0xFF)
                    k += 2
                else:
                    part.append(data[k])
                    k += 1
            streams, at = iter("".join(f"{b:08b}" for b in r) for r in [*runs, part]), end
            across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
            if len(parts) == 1:
                (h, v, blocks), _ = parts[0]
                wide, tall = -(-(-(-width * h // most_h)) // 8), -(-(-(-height * v // most_v)) // 8)
                units = [[(0, (y, x))] for y in range(tall) for x in range(wide)]
            else:
                units = [[(p, (y * f[1] + j, x * f[0] + i)) for p, (f, _) in enumerate(parts) for j in range(f[1]) for i in range(f[0])] for y in range(down) for x in range(across)]
            for n, unit in enumerate(units):
                if n == 0 or restart and n % restart == 0:
                    bits, skip, last = iter(next(streams)), 0, [0] * len(parts)
                take = lambda m: int("".join(next(bits) for _ in range(m)) or "0", 2)  # noqa: B023, E731

                def value(m):
                    x = take(m)  # noqa: B023
                    return x if not m or x >= 1 << (m - 1) else x - (1 << m) + 1

                def symbol(tree):
                    word = ""
                    while word not in tree:
                        word += next(bits)  # noqa: B023
                    return tree[word]

                for p, place in unit:
                    (_, _, blocks), tables = parts[p]
                    block = blocks[place]
                    if low == 0:
                        if ah:
                            block[0] += take(1) << al
                        else:
                            last[p] += value(symbol(trees[tables >> 4]))
                            block[0] = last[p] << al
                        continue
                    k, tree = low, trees[16 | tables & 15]
                    fix = lambda q: block.__setitem__(q, block[q] + (take(1) << al) * (1 if block[q] > 0 else -1))  # noqa: B023, E731
                    while k <= high and not skip:
                        zeros, m = divmod(symbol(tree), 16)
                        if not m and zeros < 15:
                            skip = (1 << zeros) + take(zeros)
                            break
                        new = 0 if not m else (value(m) if not ah else 2 * take(1) - 1) * (1 << al)
                        while k <= high:
                            if ah and block[natural[k]]:
                                fix(natural[k])
                            elif zeros:
                                zeros -= 1
                            else:
                                break
                            k += 1
                        if new:
                            block[natural[k]] = new
                        k += 1
                    if skip:
                        for q in range(k, high + 1) if ah else ():
                            if block[natural[q]]:
                                fix(natural[q])
                        skip -= 1
    return height, width, frame


def test_jpeg_by_an_independent_reader():
    rng = random.Random(3)
    natural = sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8))
    cosine = [[(0.5 if u else 0.125**0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)]
    for size in (64, 64 * 7, 64 * 26):
        data = bytes(rng.randrange(256) for _ in range(size - 30)) + bytes(30)
        image = progressive_jpeg.Progressive(media := progressive_jpeg.pack(data))
        height, width, frame = read_progressive(media)
        planes = []
        for c, (h, v, blocks) in zip(image.comps, frame):
            mine = [[blocks[divmod(k, c.wide)][natural[j]] for j in range(64)] for k in range(len(c.coef))]
            assert (c.h, c.v) == (h, v) and mine == c.coef.tolist()
            plane = np.zeros((8 * c.tall, 8 * c.wide))
            for (y, x), block in blocks.items():
                square = np.array(cosine) @ np.array(block, float).reshape(8, 8) @ np.array(cosine).T
                plane[8 * y : 8 * y + 8, 8 * x : 8 * x + 8] = np.clip(np.rint(square + 128), 0, 255)
            planes.append(np.kron(plane, np.ones((height // len(plane), width // len(plane[0])))))
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        want = np.clip(np.rint(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)), 0, 255)
        got = image.rgb()
        assert got.shape == (height, width, 3) and np.abs(got - want).max() <= 2 and image.payload() == data


def test_broken_media_have_no_tensor(spark):
    media = progressive_jpeg.pack(progressive_jpeg.padded(bytes(range(256)) * 3))
    rng = random.Random(1)
    cut = [media[: rng.randrange(len(media) - 2)] for _ in range(40)]
    flipped = [media[:k] + bytes([rng.randrange(256)]) + media[k + 1 :] for k in (rng.randrange(2, len(media)) for _ in range(200))]
    assert all(progressive_jpeg.tensor(x) is None for x in cut)
    for x in flipped:
        progressive_jpeg.tensor(x)  # any outcome but an error
    df = spark.createDataFrame([(1, media, "a"), (2, None, "b"), (3, b"", "c"), (4, b"no jpeg", "d"), (5, media[:99], "e")], "id long, `me.dia` binary, `x.y` string")
    out = {r.id: r for r in progressive_jpeg.decode_media(df, "me.dia").collect()}
    assert out[1].tensor and all(out[k].tensor is None and out[k].height is None for k in (2, 3, 4, 5))


def test_dotted_names_pass(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, "one two", 5), (2, None, 6)], "`doc.id` long, `te``xt.s` string, n_tokens int")
    out = bpe.encode_documents(df, path, "te`xt.s")
    assert out.columns == ["doc.id", "te`xt.s", "token_ids", "n_tokens"] and sorted(r.n_tokens for r in out.collect())[0] == 0
    assert bpe.token_digests(df, path, "doc.id", "te`xt.s").count() == 2
    assert progressive_jpeg.pack_texts(df, "te`xt.s", "m.n").columns == [*df.columns, "m.n"]


def test_jpeg_zero_runs_and_interleaved_dc():
    """A hand-made grey-scale file: DC 5, one coefficient of -3 after two zeros refined to -6, the rest zero."""
    seg, table = progressive_jpeg._segment, lambda kind, *symbols: progressive_jpeg._segment(0xC4, bytes([kind << 4, 0, 0, len(symbols), *[0] * 13, *symbols]))
    bits = lambda s: bytes(int((s + "1" * (-len(s) % 8))[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")
    sos = progressive_jpeg._sos
    data = b"\xff\xd8" + seg(0xDB, b"\x00" + b"\x01" * 64) + seg(0xC2, b"\x08\x00\x08\x00\x08\x01\x01\x11\x00") + table(0, 3, 4)
    data += sos([0], 0, 0, 0, 0) + bits("000" + "101") + table(1, 0x22, 0x00)
    data += sos([0], 1, 63, 0, 1) + bits("000" + "00" + "001") + sos([0], 1, 63, 1, 0) + bits("001" + "0") + b"\xff\xd9"
    image = progressive_jpeg.Progressive(data)
    assert image.comps[0].coef[0, 0] == 5 and image.comps[0].coef[0, 3] == -6 and np.count_nonzero(image.comps[0].coef) == 2
    assert image.rgb().shape == (8, 8, 3)


def test_mix(spark, docs, rows, empty):
    out = mixing.mix_keys(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert len(r.copies) == r.rows == 1 and 0 <= r.copies[0] <= 2
        sizes[r.source] += r["size"]
        taken[r.source] += r["size"] * r.copies[0]
        target[r.source] = r.target
    want, left = {}, sorted(sizes, key=lambda s: (s is None, s or ""))
    weights, rest = {s: (3, 1, 2)[k % 3] for k, s in enumerate(left)}, 1.5 * sum(sizes.values())
    while True:
        share = {s: rest * weights[s] / sum(weights[x] for x in left) for s in left}
        full = [s for s in left if share[s] > 2 * sizes[s]]
        if not full:
            want |= share
            break
        for s in full:
            want[s], rest = 2 * sizes[s], rest - 2 * sizes[s]
            left.remove(s)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in sizes)
    assert all(abs(taken[s] - target[s]) <= 2 * max(len(words(t)) for _, t, _, x, _ in rows if x == s) for s in sizes)
    assert sorted(map(str, mixing.mix_keys(docs.repartition(3)).collect())) == sorted(map(str, out))
    times = defaultdict(int)
    for r in mixing.mixed_documents(docs).collect():
        times[r.doc_id] += 1
    assert times == {r.doc_id: r.copies[0] for r in out if r.copies[0]}
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mix_keys(empty).count() == mixing.mixed_documents(empty).count() == 0


def test_targets_by_sharing_again_and_again(spark):
    rng = random.Random(12)
    for n in (1, 2, 5, 23):
        totals = {None if k == n - 1 and n > 2 else f"s{k:02d}": rng.choice([0, 1, 7, rng.randrange(1, 5000)]) for k in range(n)}
        got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(totals.items()), "source string, total long")).collect()}
        left = sorted(totals, key=lambda x: (x is None, x or ""))
        weights, want, rest = {x: (3, 1, 2)[k % 3] for k, x in enumerate(left)}, {}, 1.5 * sum(totals.values())
        while left:
            share = {x: rest * weights[x] / sum(weights[y] for y in left) for x in left}
            full = [x for x in left if share[x] > 2 * totals[x]]
            if not full:
                want |= share
                break
            for x in full:
                want[x], rest = 2 * totals[x], rest - 2 * totals[x]
                left.remove(x)
        assert all(abs(got[x] - want[x]) < 1e-6 for x in totals) and abs(sum(got.values()) - 1.5 * sum(totals.values())) < 1e-6


def test_mix_of_repeated_rows_and_rows_without_an_id(spark):
    data = [(None, "a b c", "s", 1, 2)] * 40 + [(None, f"x{k} y", "s", 1, 2) for k in range(30)] + [(7, "q", None, 1, 2), (7, "q r", None, 1, 2)]
    df = spark.createDataFrame(data, "doc_id long, text string, `so.urce` string, copies int, _time int")
    keys = mixing.mix_keys(df, source="so.urce").collect()
    assert sum(r.rows for r in keys) == 72 and max(r.rows for r in keys) == 40
    out = mixing.mixed_documents(df, source="so.urce")
    assert out.columns == df.columns and out.count() == sum(sum(r.copies) for r in keys)
    assert out.where("text = 'a b c'").count() == sum(sum(r.copies) for r in keys if r.rows == 40) > 0


def base_spans(text):
    """The fixed kinds, as (kind, start, end)."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def luhn(d):
        return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0

    def fits(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(x) < 256 for x in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, text) if fits(k, m.group())]


def context_spans(texts):
    """Spans of kind id in each text, by the definition: patterns and tokens as a graph, beliefs until none rises."""
    white = "\x20\x09-\x0D"
    tokens = []
    for d, text in enumerate(texts):
        base, found = base_spans(text), list(re.finditer(rf"(?<![^{white}])[^{white}0-9@]*[0-9@][^{white}]*", text))
        for n, m in enumerate(found):
            start = m.end() - len(m.group().lstrip("\"'(<[{"))
            value = text[start : m.end()].rstrip(".,;:!?\"')>]}")
            end = start + len(value)
            seed = any(x < end and y > start for _, x, y in base)
            if seed or len(value) >= 8 and sum("0" <= c <= "9" for c in value) >= 4:
                left = re.search(rf"([^{white}]+)[{white}]+$", text[found[n - 1].end() if n else 0 : m.start()])
                right = re.match(rf"[{white}]+([^{white}]+)", text[m.end() : found[n + 1].start() if n + 1 < len(found) else len(text)])
                tokens.append((d, start, end, value, {p + x.group(1).lower() for p, x in (("L:", left), ("R:", right)) if x}, seed))
    graph, seeded, plain = defaultdict(set), {t[3] for t in tokens if t[5]}, {t[3] for t in tokens if not t[5]}
    for *_, value, patterns, _ in tokens:
        for p in patterns:
            graph[p].add(value)
    graph = {p: v for p, v in graph.items() if len(v & seeded) >= contextual_pii.MIN_SEEDS}
    belief, of = {v: float(v in seeded) for vs in graph.values() for v in vs}, defaultdict(list)
    for p, vs in graph.items():
        for v in vs:
            of[v].append(p)
    for _ in range(200):
        sure = {p: sum(belief[v] for v in vs) / (len(vs) + contextual_pii.PRIOR) for p, vs in graph.items()}
        sure = {p: c if c >= contextual_pii.MIN_CONFIDENCE else 0.0 for p, c in sure.items()}
        belief = {v: 1.0 if v in seeded else 1 - np.prod([1 - min(sure[p], 0.999999) for p in of[v]]) for v in belief}
    sure = {v for v in belief if v not in seeded and belief[v] >= contextual_pii.MIN_BELIEF} | (seeded & plain)
    out = [set() for _ in texts]
    for d, start, end, value, _, seed in tokens:
        if not seed and value in sure:
            out[d].add(("id", start, end))
    return [sorted(x) for x in out]


def redacted(text, spans):
    merged = []
    for start, end, kind in sorted((x, y, k) for k, x, y in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    out, at = "", 0
    for start, end, kind in merged:
        out, at = out + text[at:start] + f"[{kind.upper()}]", end
    return out + text[at:]


def test_base_spans(docs, rows, empty):
    more = context_spans([r[1] or "" for r in rows])
    want = {r[0]: base_spans(r[1] or "") + x for r, x in zip(rows, more)}
    for r in contextual_pii.find_personal_data(docs).collect():
        spans = [":".join(map(str, s)) for s in want[r.doc_id]]
        assert r.base_sha256 == hashlib.sha256(",".join(x for x in spans if not x.startswith("id")).encode()).hexdigest() and r.spans == ",".join(spans)
        assert (r.n_spans, r.n_id) == (len(spans), sum(x.startswith("id") for x in spans))
    assert contextual_pii.find_personal_data(empty).count() == 0


def test_contexts_discover(spark):
    seeds = [(k, f"write to ssh key{k}@x.example.org today") for k in range(12)]
    df = spark.createDataFrame([*seeds, (50, "write to ssh K9X8-7Y65-4321 today 😀"), (51, "in version 12345678 of it")], "doc_id long, text string")
    extra = {r.doc_id: r.spans for r in contextual_pii.find_personal_data(df).collect()}
    assert extra[50] == "id:13:27" and extra[51] == ""
    cleaned = {r.doc_id: r.text for r in contextual_pii.redact(df).collect()}
    assert cleaned[50] == "write to ssh [ID] today 😀" and cleaned[3] == "write to ssh [EMAIL] today" and cleaned[51] == df.where("doc_id = 51").first().text


def test_seeds_are_spans_where_patterns_miss_them(spark):
    data = [(1, "card 4845168114407329 ok"), (2, "7536784127813050 4845168114407329"), (3, "ring +1 (555) 000-1000 now"), (4, "or 000-1000 then")]
    out = {r.doc_id: r.spans for r in contextual_pii.find_personal_data(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out == {1: "card:5:21", 2: "id:17:33", 3: "phone:5:22", 4: "id:3:11"}


def test_chains_of_contexts_are_followed_to_their_end(spark):
    around = lambda k, x: f"before{'abcdefgh'[k]} {x} after{'abcdefgh'[k]}"
    texts = [around(0, f"s{j}@x.example.org") for j in range(8)]
    for k in range(8):
        texts += [around(k, f"s{k}{j}@y.example.org") for j in range(4) if k]
        texts += [around(at, f"U{k}X{j}-5555") for j in range(2) for at in (k, k + 1) if at < 8]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.spans for r in contextual_pii.find_personal_data(df).collect()}
    assert all(out[i].startswith("id:") for i, t in enumerate(texts) if "-5555" in t)


def test_long_words_and_wide_gaps_are_context(spark):
    long = "x" * 300
    data = [(k, f"{long}{'ab'[k % 2]} {' ' * 200} key{k}@x.example.org") for k in range(24)] + [(50, f"{long}a {' ' * 200} K9X8-7Y65"), (51, f"{long}c K9X8-7Y66")]
    out = {r.doc_id: (r.n_id, r.n_spans) for r in contextual_pii.find_personal_data(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert out[50] == (1, 1) and out[51] == (0, 0) and out[3] == (0, 1)


def test_time_follows_the_number_of_matches(spark):
    import time

    took = {}
    for n in (16_000, 32_000):
        text = " ".join(f"é10.{k % 250}.{k // 250}.7 y" for k in range(n))
        began = time.time()
        got = contextual_pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text
        took[n] = time.time() - began
        assert got == " ".join(["é[IP] y"] * n)
    assert took[32_000] < 3 * took[16_000]


def test_overlapping_spans_become_one(spark):
    rows = [(1, "mail +49 30 1234567890.x@mail.example.com and 1.2.3.4@b.example.org, 10.0.0.1"), (2, "a" * 5000 + " z9@m.example.com " + "b" * 5000)]
    df = spark.createDataFrame([(*r, "o", 1, 2) for r in rows], "doc_id long, `te.xt` string, own_id string, spans int, `_blo.cks` int")
    spans = {r.doc_id: r.spans for r in contextual_pii.find_personal_data(df, text="te.xt").collect()}
    out = {r.doc_id: r for r in contextual_pii.redact(df, text="te.xt").collect()}
    for i, text in rows:
        merged = []
        for kind, start, end in sorted((s.split(":") for s in spans[i].split(",")), key=lambda s: (int(s[1]), int(s[2]), s[0])):
            if merged and int(start) < merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], int(end))
            else:
                merged.append([kind, int(start), int(end)])
        want, at = "", 0
        for kind, start, end in merged:
            want, at = want + text[at:start] + f"[{kind.upper()}]", end
        assert out[i]["te.xt"] == want + text[at:] and out[i].own_id == "o" and out[i].spans == 1


def test_contexts_as_brute_force_has_them(spark):
    """Spans of kind id against the same definition in plain Python; planted identifiers are found."""
    rng = random.Random(11)
    words_, seeds = [f"v{'abcdefghij'[k % 10]}{'klmnop'[k % 6]}" for k in range(30)], [f"u{k}@h{k % 7}.example.org" for k in range(80)]
    texts, planted = [], 0
    for k in range(240):
        w = [rng.choice(words_) for _ in range(rng.randrange(3, 20))]
        at = rng.randrange(len(w))
        if k % 3 == 0:
            w[at:at] = ["account:", seeds[k // 3], "closed"]
        elif k % 6 == 1:
            w[at:at] = ["account:", f"AC{rng.randrange(10**6):06d}-{k}", "closed"]
            planted += 1
        else:
            w[at:at] = [rng.choice(words_), f"build{rng.randrange(10**5):05d}", rng.choice(words_)]
        texts.append(" ".join(w))
    want = {(d, f"id:{start}:{end}") for d, spans in enumerate(context_spans(texts)) for _, start, end in spans}
    out = contextual_pii.find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {(r.doc_id, s) for r in out for s in r.spans.split(",") if s.startswith("id:")} == want
    assert sum("AC" in texts[d] for d, _ in want) >= 0.9 * planted


def test_many_matches_are_located(spark):
    text = " ".join(f"é{k}@m.example.com," for k in range(400))
    got = contextual_pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert got.spans == ",".join(want) and got.n_email == 400


def test_simhash_components(spark, docs, rows, empty):
    rng = random.Random(3)
    base = [f"t{k}" for k in range(120)]
    near = []
    for k in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"z{k}"
        near.append((1000 + k, " ".join(w), "en", "hot", 1))
    every = rows + near
    out = simhash_pivot.near_duplicates(docs.unionByName(spark.createDataFrame(near, SCHEMA))).collect()
    fp = {i: simhash_pivot.fingerprint(t) for i, t, *_ in every}
    label = {i: i for i in fp}
    for i in sorted(fp):  # breadth first from each smallest id
        if label[i] == i:
            queue = [i]
            for a in queue:
                for b in fp:
                    if label[b] > i and (fp[a] ^ fp[b]).bit_count() <= 2:
                        label[b] = i
                        queue.append(b)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {i: (f"{fp[i]:016x}", label[i]) for i in fp}
    kept = simhash_pivot.representatives(docs)
    assert kept.columns == docs.columns and simhash_pivot.near_duplicates(empty).count() == 0


def test_components_of_rows_without_an_id(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    data = [(None, text("a")), (None, text("b")), (5, text("b")), (5, text("c")), (3, text("c")), (None, None), (None, "")]
    out = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash_pivot.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()]
    fp = lambda t: f"{simhash_pivot.fingerprint(t):016x}"
    want = [(None, fp(text("a")), None), (None, fp(text("b")), 5), (5, fp(text("b")), 5), (5, fp(text("c")), 3), (3, fp(text("c")), 3), (None, "0" * 16, None), (None, "0" * 16, None)]
    assert sorted(out, key=str) == sorted(want, key=str)


def test_near_copies_are_one(spark):
    rng = random.Random(8)
    shared = " ".join(f"s{k}" for k in range(40))
    texts = []
    for _ in range(25):
        w = [f"v{rng.randrange(500)}" for _ in range(rng.randrange(30, 160))]
        for edits in (0, 0, 1, 2, 3, 6):
            x = list(w)
            for _ in range(edits):
                x[rng.randrange(len(x))] = f"e{rng.random()}"
            texts.append(" ".join(x) + (" " + shared if len(texts) % 3 else ""))
    texts += ["a b", "A b", "a c", "", None, "one two three four five six"]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in (words((t or "").lower()) for t in texts)]
    alike = lambda a, b: 5 * len(a & b) >= 4 * len(a | b)
    label = list(range(len(texts)))
    for i in range(len(texts)):
        if label[i] == i:
            queue = [i]
            for a in queue:
                for b in range(len(texts)):
                    if label[b] > i and alike(sets[a], sets[b]):
                        label[b] = i
                        queue.append(b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in simhash_pivot.representatives(df).collect()} == set(label)
    wide = sum(label[b] == label[a] and (simhash_pivot.fingerprint(texts[a]) ^ simhash_pivot.fingerprint(texts[b])).bit_count() > 2 for b in range(len(texts)) for a in range(b))
    assert wide > 20  # what two bits of 3-word fingerprints don't link


def test_large_groups_are_united_before_pairs_are_listed(spark):
    """Near copies of one text: far fewer pairs are verified than there are, and none is lost by parities."""
    rng = random.Random(9)
    base = [f"v{k}" for k in range(150)]
    texts = []
    for _ in range(400):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(150)] = f"e{rng.random()}"
        texts.append(" ".join(w))
    cache = simhash_pivot.WordHash()
    sets = [simhash_pivot.shingle_set(t, cache) for t in texts]
    odd = np.array([simhash_pivot.parities(x) for x in sets]).view(np.uint64)
    for _ in range(3000):
        a, b = rng.sample(range(400), 2)
        assert np.bitwise_count(odd[a] ^ odd[b]).sum() <= len(np.setxor1d(sets[a], sets[b]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    verify = simhash_pivot.verified
    try:
        simhash_pivot.verified = lambda pairs, *more: (seen.append(pairs.distinct().count()), verify(pairs, *more))[1]
        kept = [r.doc_id for r in simhash_pivot.representatives(df).collect()]
    finally:
        simhash_pivot.verified = verify
    label, queue = {0}, [0]
    for a in queue:
        for b in range(400):
            if b not in label and simhash_pivot.similar(sets[a], sets[b]):
                label.add(b)
                queue.append(b)
    assert 0 in kept and len(kept) == 400 - len(label) + 1 and sum(seen) < 20_000


def test_texts_are_sent_once_for_a_block_of_pairs(spark, monkeypatch):
    """All pairs of 300 near copies and some of others: far fewer texts are sent than there are pairs, each pair is compared
    once, where both of its texts are, and those that are similar are found, in large and in small blocks."""
    rng = random.Random(13)
    base = [f"b{i}" for i in range(100)]
    texts = [" ".join(w if rng.random() > 0.02 else f"e{k}x{i}" for i, w in enumerate(base)) for k in range(300)]
    texts += [None, "", "one", *(" ".join(f"c{k // 2}x{i}" for i in range(20 + k % 2)) for k in range(40))]
    few = [(a, a + 1) for a in range(300, len(texts) - 1)]
    every = [*((a, b) for b in range(300) for a in range(b)), *few]
    cache = simhash_pivot.WordHash()
    sets = [simhash_pivot.shingle_set(t, cache) for t in texts]
    want = {p for p in every if simhash_pivot.similar(sets[p[0]], sets[p[1]])}
    assert 1000 < len(want) < len(every) - 1000 and want & set(few)
    docs = spark.createDataFrame(list(enumerate(texts)), "text_key long, text string")
    keys = docs.selectExpr("text_key AS sig", "text_key")
    pairs = spark.createDataFrame(every, "a long, b long")
    real, seen = simhash_pivot.in_blocks, []

    def watched(*given):
        out = real(*given)
        seen.extend((r.block, r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(simhash_pivot, "in_blocks", watched)
    for most, copies in ((128, 4), (16, 26)):
        monkeypatch.setattr(simhash_pivot, "PART_TEXTS", most)
        seen.clear()
        assert {(r.a, r.b) for r in simhash_pivot.verified(pairs.union(pairs), keys, docs).collect()} == want
        assert sorted(r[1:] for r in seen) == sorted(every)
        sent = {(block, x) for block, *both in seen for x in both}
        assert len(sent) <= 300 * copies + 4 * len(few) < len(every) / 4
        assert max(Counter(block for block, _ in sent).values()) <= 4 * most


def test_unlike_texts_that_quote_the_same_aren_t_paired(spark):
    """Long texts that share passages with two others each, and some near copies of these."""
    rng = random.Random(10)
    texts = []
    for k in range(90):
        own = [f"o{k}x{i}" for i in range(1500)]
        at = rng.randrange(1500)
        texts.append(" ".join(own[:at] + [f"q{k // 3}x{i}" for i in range(500)] + own[at:]))
    near = [t.replace(" o", " é", 20) for t in texts[:10]]
    df = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string")
    seen = []
    verify = simhash_pivot.verified
    try:
        simhash_pivot.verified = lambda pairs, *more: (seen.append(pairs.where("a <> b").distinct().count()), verify(pairs, *more))[1]
        kept = [r.doc_id for r in simhash_pivot.representatives(df).collect()]
    finally:
        simhash_pivot.verified = verify
    assert sorted(kept) == list(range(90)) and sum(seen) <= 20


def test_first_shingles_that_others_have(spark, monkeypatch):
    """By brute force: the first shingles of each set in the order of the number of rows that have them, in several chunks."""
    monkeypatch.setattr(simhash_pivot, "CHUNK", 900)
    rng = random.Random(11)
    texts = ["", None, "a b", "a b"]
    for k in range(60):
        w = [f"u{k}x{i}" for i in range(rng.randrange(40))] + [f"v{rng.randrange(3)}" for _ in range(60)]
        texts += [" ".join(w)] * rng.randrange(1, 3)
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "doc_id long, text_key long, text string").repartition(2)
    bits = 11
    marks = simhash_pivot.shingle_marks(df, bits).cache()
    got = {r.sig: (r.alone, np.frombuffer(r.firsts, np.int64).tolist()) for r in simhash_pivot.first_shingles(marks).collect()}
    sig = {r.doc_id: (r.sig, r.n) for r in marks.where("chunk IS NULL").collect()}
    assert marks.where("bucket < 0").count() > 3
    marks.unpersist()
    cache = simhash_pivot.WordHash()
    sets = [[int(x) >> (32 - bits) for x in simhash_pivot.shingle_set(t, cache)] for t in texts]
    rows = Counter(x for own in sets for x in own)
    want = {}
    for i, own in enumerate(sets):
        order = sorted(own, key=lambda x: (rows[x], x))[: simhash_pivot.prefix_length(len(own))]
        assert sig[i][1] == len(own)
        if first := [x for x in order if rows[x] > 1]:
            want[sig[i][0]] = (sum(rows[x] == 1 for x in own), first)
    assert got == want


def test_rows_without_an_id_are_documents(spark):
    text = lambda k: " ".join(f"{k}{i}" for i in range(30))
    data = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("c")), (7, text("d")), (8, text("d")), (9, text("d") + " e")]
    kept = simhash_pivot.representatives(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d"))], key=str)


def test_clashing_names_pass_near_dedup(spark):
    text = " ".join(f"a{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 5, 6, 7), (2, text, 5, 6, 8), (None, None, 0, 0, 0)], "doc_id long, `te.xt` string, key int, _first_id int, `root.x` int")
    kept = simhash_pivot.representatives(df, text="te.xt")
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(1, text, 5, 6, 7), (None, None, 0, 0, 0)], key=str)


@pytest.mark.parametrize("members", [2, 60, 2000, 20_000])
def test_files_of_fingerprints(members):
    rng = np.random.default_rng(members)
    free = np.unique(rng.integers(0, 1 << 16, members)).astype(np.uint64)
    choice = len(simhash_pivot.CHOICES) - 1  # bands 6 and 7 are free
    fp = np.concatenate([free << np.uint64(48), free[:50] << np.uint64(48) | np.uint64(1)])  # two files
    file = np.repeat([0, 1], [len(free), len(free[:50])])
    a, b = simhash_pivot.linked_pairs(file, fp, np.full(len(fp), choice))
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(fp)) for j in (i + 1 + np.nonzero((np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 2) & (file[i + 1 :] == file[i]))[0]).tolist()}
    assert got == want and len(a) == len(got)


def test_pivot_table_counts_ones():
    free = np.arange(1 << 16)
    assert (simhash_pivot.pivot_table(free).sum(0) == np.bitwise_count(free)).all()


def test_url_rules(spark):
    urls = ["http://A.Example.NET/en/x?q", "https://example.com/de/", "https://w.org/fr/1#a", "http://x.net", "http://x.net/", "nourl", None, "ftp://h/p://q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad int")
    out = {r.page_id: tuple(r)[1:5] for r in host_reputation.judge_urls(pages, none).collect()}
    assert out[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and out[1][2:] == ("example.com/de/", "block") and out[2][2] == "org/fr/"
    assert out[3] == ("x.net", "", None, "allow") and out[4][2:] == ("net/", "block") and out[5] == out[6] == ("", "", None, "allow") and out[7][:2] == ("h", "/p://q")


def test_reputation_blocks_bad_hosts(spark):
    pages = spark.createDataFrame([(k, f"http://{'bad' if k % 2 else 'good'}.example.io/{k}") for k in range(400)] + [(999, "http://new.example.io/")], "page_id long, url string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(400)], "page_id long, bad int")
    verdicts = {(r.host, r.verdict) for r in host_reputation.judge_urls(pages, labels).collect()}
    assert verdicts == {("bad.example.io", "block"), ("good.example.io", "allow"), ("new.example.io", "allow")}


def test_hosts_inherit_from_their_domain(spark):
    """A host without labels has its domain's posterior; siblings of one domain can differ; suffixes come from the list."""
    pages, labels, k = [], [], 0
    for domain, rate in (("spam.co.uk", 0.9), ("fine.co.uk", 0.05), ("okay.org", 0.05), ("mild.org", 0.1), ("nice.com", 0.05)):
        for host in ("a", "b", "c"):
            worse = 0.95 if (domain, host) == ("mild.org", "c") else rate
            for j in range(120):
                pages.append((k, f"https://{host}.{domain}/p/{j}"))
                labels.append((k, int(j < 120 * worse)))
                k += 1
        pages.append((k, f"https://new.{domain}/"))
        k += 1
    pages, labels = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int")
    out = {r.host: r for r in host_reputation.judge_urls(pages, labels).collect()}
    blocked = {h for h, r in out.items() if r.verdict == "block"}
    assert {"a.spam.co.uk", "b.spam.co.uk", "c.spam.co.uk", "c.mild.org"} <= blocked and not blocked & {"a.fine.co.uk", "a.mild.org", "b.mild.org", "new.fine.co.uk", "a.nice.com"}
    assert out["new.spam.co.uk"].n == 0 and out["new.spam.co.uk"].mean > out["new.fine.co.uk"].mean + 0.2
    merged = {r.host: r for r in host_reputation.judge_urls(pages, labels, suffixes=()).collect()}  # without the list co.uk is one domain
    assert abs(merged["new.spam.co.uk"].mean - merged["new.fine.co.uk"].mean) < 1e-9


def test_url_filter_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    labels = spark.createDataFrame([(None, 1), (1, None), (1, 0), (1, 1), (50, 1)], "page_id long, bad int")
    assert host_reputation.judge_urls(none, labels).count() == 0
    twice = spark.createDataFrame([(1, "http://a.b/"), (1, "http://a.b/"), (None, "http://a.b/x")], "page_id long, `u.rl` string")
    assert {(r.page_id, r.n, r.bad) for r in host_reputation.judge_urls(twice, labels, url="u.rl").collect()} == {(1, 2, 2), (None, 2, 2)}
    pages = spark.createDataFrame([(3, "http://h/en/12?x"), (4, "http://h/12"), (5, None)], "page_id long, url string")
    assert [tuple(r) for r in host_reputation.page_outcomes(pages, spark.createDataFrame([(12, 1)], "doc_id long, bad int")).collect()] == [(3, 1)]


def test_interleave(docs, rows, empty):
    out = interleave.interleave(docs, shards=7).collect()
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
        text = (next(x[1] for x in rows if x[0] == r.doc_id) or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 16, zlib.crc32(text), "rows")
    counts = [len(v) for v in by.values()]
    assert len(by) == 7 and max(counts) - min(counts) <= 1 and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    source = {i: s for i, _, _, s, _ in rows}
    for s in ("src0", "src1", "src2"):
        share = [sum(source[r.doc_id] == s for r in v) for v in by.values()]
        assert max(share) - min(share) <= 2
    assert sorted(map(tuple, interleave.interleave(docs.repartition(2), shards=7).collect()), key=str) == sorted(map(tuple, out), key=str)
    assert interleave.interleave(empty).count() == 0


def test_places_by_brute_force(spark):
    data = [(None, f"t{k % 7}", "a") for k in range(50)] + [(k % 9, "x" * k, "b" if k % 3 else None) for k in range(80)]
    out = interleave.interleave(spark.createDataFrame(data, "doc_id long, `t.ext` string, range string").repartition(4), shards=9, text="t.ext", source="range").collect()
    ranked = defaultdict(list)
    for i, text, source in data:
        crc = zlib.crc32(text.encode())
        ranked[source].append((hashlib.md5(f"shard-1|{'-' if i is None else i}|{crc}".encode()).hexdigest(), i, crc, len(text) + 16))
    order = sorted(((k + 0.5) / len(v), s is None, s or "", row) for s, v in ranked.items() for k, row in enumerate(sorted(v, key=lambda r: (r[0], r[2]))))
    n, want = len(order), []
    for place, (*_, (h, i, crc, size)) in enumerate(order):
        shard = place * 9 // n
        want.append((i, size, crc, "rows", shard, place - -(-shard * n // 9), None))
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_pipeline_by_brute_force(spark, sf_dir):
    """Every stage's rows from plain Python, given the classifier's weights; the last one's ids from the library."""
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    made, docs = {}, read("documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        made[name] = [tuple(r) for r in docs.collect()]
        docs = spark.createDataFrame(made[name], docs.schema)
    whole = [tuple(r) for r in read("documents").collect()]
    cols = read("documents").columns
    at = {c: cols.index(c) for c in cols}
    ident, text_of, source_of = (lambda r: r[at["doc_id"]]), (lambda r: r[at["text"]] or ""), (lambda r: r[at["source"]])
    same = lambda a, b: sorted(a, key=str) == sorted(b, key=str)

    # classifier: sites by the urls, posteriors by their formula
    model = site_quality.fit_text_model(read("documents"), site_quality.bad_labels(read("labels")))
    site = {}
    for r in read("pages").collect():
        m = re.match(r".*?://([^/?#]*)/([^/?#]*)/([0-9]{1,18})", r.url or "")
        if m:
            here = (m[1].lower(), m[2])
            site[int(m[3])] = min(site.get(int(m[3]), here), here)
    p = {ident(r): 1 / (1 + np.exp(-model.logit(text_of(r)))) for r in whole}
    assert len(p) == len(whole)
    total, n = sum(p.values()), len(p)

    def strength(groups):
        children = [(g, np.array(v)) for g, c in groups.items() for v in c.values()]
        size, df_b = sum(len(v) for _, v in children), len(children) - len(groups)
        if df_b <= 0 or size <= len(children):
            return 9999.0
        pooled = {g: np.concatenate(list(c.values())).mean() for g, c in groups.items()}
        b = sum(len(v) * (v.mean() - pooled[g]) ** 2 for g, v in children) / df_b
        w = sum(((v - v.mean()) ** 2).sum() for _, v in children) / (size - len(children))
        n0 = (size - sum(sum(len(v) ** 2 for v in c.values()) / sum(map(len, c.values())) for c in groups.values())) / df_b
        return 1 / min(max((b - w) / (b + (n0 - 1) * w), 0.0001), 0.5) - 1

    homed = [k for k in p if k in site]
    by_host, by_path = defaultdict(lambda: defaultdict(list)), defaultdict(lambda: defaultdict(list))
    for k in homed:
        by_host[0][site[k][0]].append(p[k])
        by_path[site[k][0]][site[k]].append(p[k])
    host_k, path_k = strength(by_host), strength(by_path)
    good = []
    for r in whole:
        k = ident(r)
        base = rate = (total - p[k] + 0.5) / n
        if k in site:
            same_host, same_path = by_host[0][site[k][0]], by_path[site[k][0]][site[k]]
            rate = (sum(same_host) - p[k] + host_k * base) / (len(same_host) - 1 + host_k)
            rate = (sum(same_path) - p[k] + path_k * rate) / (len(same_path) - 1 + path_k)
        odds = p[k] / (1 - p[k]) * rate / (1 - rate) * (1 - base) / base
        if odds / (1 + odds) <= site_quality.REJECT_ABOVE:
            good.append(r)
    assert same(good, made["quality classifier"]) and len(good) < len(whole)

    # near copies: groups by Jaccard similarity of 5-word shingles, the smallest id of each
    sets = []
    for r in good:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text_of(r)))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(good)))
    order = sorted(range(len(good)), key=lambda k: ident(good[k]))
    seen, one = set(), []
    for i in order:
        if i not in seen:
            one.append(good[i])
            queue = [i]
            seen.add(i)
            for x in queue:
                for y in range(len(good)):
                    if y not in seen and 5 * len(sets[x] & sets[y]) >= 4 * len(sets[x] | sets[y]):
                        seen.add(y)
                        queue.append(y)
    assert len(label) and same(one, made["SimHash near-dedup"]) and len(one) < len(good)

    # personal data
    clean = []
    for r, more in zip(one, context_spans([text_of(r) for r in one])):
        text = redacted(text_of(r), base_spans(text_of(r)) + more) if r[at["text"]] is not None else None
        clean.append((*r[: at["text"]], text, *r[at["text"] + 1 :]))
    assert same(clean, made["PII"]) and clean != one

    # the mix: one order by size class for each source, and a copy for each integer boundary
    size = {ident(r): len(words(text_of(r))) for r in clean}
    groups = defaultdict(list)
    for r in clean:
        tie = hashlib.md5(text_of(r).encode()).hexdigest()
        salt = int(hashlib.md5(f"mix-1|{ident(r)}|{tie}".encode()).hexdigest()[:8], 16) % mixing.SALTS
        groups[source_of(r)].append((int(np.floor(4 * np.log2(size[ident(r)] + 1.0))), salt, size[ident(r)], ident(r), tie, r))
    names = sorted(groups, key=lambda x: (x is None, x or ""))
    totals, weights = {x: sum(g[2] for g in groups[x]) for x in names}, {x: (3, 1, 2)[k % 3] for k, x in enumerate(names)}
    target, left, rest = {}, list(names), 1.5 * sum(totals.values())
    while left:
        share = {x: rest / sum(weights[y] for y in left) * weights[x] for x in left}  # as a level, to the last bit
        full = [x for x in left if share[x] > 2 * totals[x]]
        if not full:
            target |= share
            break
        for x in full:
            target[x], rest = 2 * totals[x], rest - 2 * totals[x]
            left.remove(x)
    mix = []
    for x in names:
        u = int(hashlib.md5(f"mix-1|{x or ''}".encode()).hexdigest()[:8], 16) / 4294967296
        rate = target[x] / totals[x] if totals[x] else 0.0
        for k, g in enumerate(sorted(groups[x], key=lambda g: g[:5])):
            mix += [g[5]] * int(np.floor(u + rate * (k + 1.0)) - np.floor(u + rate * k))
    assert same(mix, made["source mix"])

    encode = tokenizers.Tokenizer.from_file(path).encode
    want = [(*r, ids, len(ids)) for r in mix for ids in [encode(text_of(r), add_special_tokens=False).ids]]
    assert same(want, made["BPE"])
    assert docs.columns == [*cols, "token_ids", "n_tokens"] and corpus_pipeline.run(spark, sf_dir).count() == len(want)
