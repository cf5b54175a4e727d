"""Each operator against brute force, round trips, held-out accuracy and odd inputs."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweft.llm import chunks, components, decontaminate, html, media, mixing, neardup, quality, sharding, toxicity, warc
from lexweft.llm.common import mix64, text_bytes, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t ", "a", "É", "a b", "x" * 30000, "word " * 3000, "a b c d e f g h i j k l", "\x00 \u0001", "𝔘nicode 😀 text"]
VOCABULARY = [f"{a}{b}{c}" for a in ("tor", "mel", "kip", "sa") for b in ("o", "in", "ul") for c in ("ta", "rek", "v", "mos")]


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, "en" if i % 2 else None, None, None) for i, t in enumerate(ODD)] + [(4, "a", "en", "s", 1), (None, "no id", None, None, None), (None, None, "xx", None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("k", F.lit(1)).withColumn("shard", F.lit("x")).withColumn("score", F.lit("y"))


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_words_are_runs_outside_breaks():
    import pyarrow as pa

    texts = ["The the\tTHE  x", None, "", "é É", " lead", "trail "]
    data, off = text_bytes(pa.array(texts))
    h, rows, starts, ends = words_of(data, off)
    words = [w for t in texts for w in (t or "").split()]
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == words
    assert h[0] == h[1] == h[2] and h[4] != h[5] and list(rows) == [0, 0, 0, 0, 3, 3, 4, 5]


# --- WARC ---------------------------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>\r\n\r\nWARC/1.1\r\n" * 4000
    rows = [(3, "http://a/", "x"), (1, "http://b/\r\nX: y", "x"), (2, None, None), (5, "u", ""), (6, "u", big), (7, "u", big), (8, "u", "0\r\n\r\n"), (None, "u", "x"), (9, "u", "y"), (9, "u", "y")]
    out = warc.warc_round_trip(pages_of(spark, rows)).collect()
    assert len(out) == len(rows)
    for r in out:
        if r["page_id"] is not None:
            raw = next(h for p, _, h in rows if p == r["page_id"]) or ""
            assert r["payload_bytes"] == len(raw.encode())
            assert r["payload_digest"] == __import__("base64").b32encode(hashlib.sha1(raw.encode()).digest()).decode()
    got = defaultdict(list)
    for r in out:
        got[r["page_id"]].append((r["record_type"], r["refers_to"]))
    assert got[1] == [("response", None)] and got[3] == [("revisit", 1)] and got[5] == [("revisit", 2)] and got[7] == [("revisit", 6)]
    assert got[None] == [("revisit", 1)] and got[9] == [("response", None)] * 2
    warc.write_warc(pages_of(spark, rows), str(tmp_path / "w"), segment_bytes=1000, chunk_bytes=77, revisit_from=3)
    back = {r["page_id"]: bytes(r["payload"]) for r in warc.read_warc(spark, str(tmp_path / "w")).filter("warc_type = 'response' AND page_id IS NOT NULL").collect()}
    assert back[6] == big.encode() and back[8] == b"0\r\n\r\n" and back[3] == b"x" and back[1] == b"x"
    urls = {r["page_id"]: r["url"] for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert urls[1] == "http://b/\r\nX: y" and urls[6] == "u" and urls[2] is None
    odd = [(i, u, "t", "a", 1) for i, u in enumerate([" lead", "trail\u00a0", "a\tb", "%0A", "é", ""])]
    warc.write_warc(spark.createDataFrame(odd, "page_id long, url string, html string, sha string, seg int").coalesce(1), str(tmp_path / "u"), file_bytes=3 * (16384 + warc.HEADER_BYTES))
    assert {r["page_id"]: r["url"] for r in warc.read_warc(spark, str(tmp_path / "u")).collect()} == {i: u for i, u, *_ in odd}
    assert len(list((tmp_path / "u").glob("part-*"))) == 2
    raw = b"".join(__import__("gzip").decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    assert raw.count(b"WARC-Type: continuation") > 50 and raw.startswith(b"WARC/1.1\r\n")
    assert warc.warc_round_trip(pages_of(spark, [])).count() == 0


def test_segments_must_be_whole(spark, tmp_path):
    warc.write_warc(pages_of(spark, [(1, "u", "abc" * 500)]), str(tmp_path / "w"), segment_bytes=400)
    data = b"".join(__import__("gzip").decompress(f.read_bytes()) for f in (tmp_path / "w").glob("part-*"))
    records = list(warc.parse_records(data))
    head = b"".join(b for _, b in sorted(records, key=lambda r: int(r[0]["warc-segment-number"])))
    assert warc.http_payload(head) == b"abc" * 500
    (tmp_path / "cut").mkdir()
    keep = data.split(b"WARC/1.1\r\n")
    (tmp_path / "cut/a.warc").write_bytes(b"WARC/1.1\r\n".join(keep[:2] + keep[3:]))
    with pytest.raises(Exception, match="segments are missing"):
        warc.read_warc(spark, str(tmp_path / "cut")).collect()
    with pytest.raises(ValueError):
        warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nabc")


# --- quality ------------------------------------------------------------------------------------------------------


def kneser_ney(texts, n=quality.ORDER):
    """Interpolated modified Kneser-Ney from the definition, by dictionaries."""
    counts = [Counter() for _ in range(n + 1)]
    for t in texts:
        b = bytes(max(x, 1) for x in t.encode())
        padded = bytes(n - 1) + b
        for i in range(len(b)):
            counts[n][padded[i : i + n]] += 1
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc = [quality.discounts(Counter(counts[k].values())) for k in range(n + 1)]

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        seen = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not seen:
            return p(g[1:])
        d = lambda c: disc[k][min(c, 3) - 1]
        total = sum(seen.values())
        c = seen.get(g, 0)
        return ((c - d(c)) / total if c else 0) + sum(map(d, seen.values())) / total * p(g[1:])

    return p


def test_perplexity_equals_definition(spark, monkeypatch):
    rng = random.Random(3)
    texts = [sentence(rng, 12) for _ in range(12)] + ["zzz é!"]
    docs = spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, k long")
    p = kneser_ney(texts[:6])
    counts = docs.filter("doc_id < 6").select("lang", "text").mapInArrow(quality._counter, "lang string, g long, c long").groupBy("lang", "g").agg(F.sum("c").alias("c"))
    model = quality.model_tables(counts)
    want = {}
    for i, t in enumerate(texts):
        b = bytes(quality.ORDER - 1) + t.encode()
        want[i] = sum(np.log(p(b[j : j + quality.ORDER])) for j in range(len(t.encode())))
    for rows in (10**9, 150):  # one shard, then many
        monkeypatch.setattr(quality, "SHARD_ROWS", rows)
        got = {r["doc_id"]: r["s"] for r in quality.perplexities(docs, model).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[i] - want[i]) < 1e-3 * max(1, abs(want[i])) for i in want)


def test_probabilities_sum_to_one():
    p = kneser_ney(["abab abba", "baab"], 3)
    assert abs(sum(p(b"ab" + bytes([x])) for x in range(256)) - 1) < 1e-9


def test_quality_rejects_junk(spark):
    rng = random.Random(5)
    good = [(i, sentence(rng, 60) + ".", "en") for i in range(400)]
    bad = [(1000 + i, " ".join(w.upper() + "!!%%" for w in sentence(rng, 60).split()), "en") for i in range(20)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in good[:300]] + [(i, 0, 0) for i, _, _ in bad[:5]], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r["keep"] for r in quality.quality(docs, labels).collect()}
    assert not any(out[i] for i, _, _ in bad)
    assert sum(out[i] for i, _, _ in good) >= 0.97 * len(good)


def test_quality_judges_small_languages(spark):
    """Three languages with 15 to 40 trusted documents each: none has 20 held-out ones, all reject junk."""
    rng = random.Random(6)
    docs, labels = [], []
    for n, (lang, trusted) in enumerate((("en", 40), ("de", 25), ("fr", 15))):
        docs += [(1000 * n + i, sentence(rng, 60) + ".", lang) for i in range(100)]
        docs += [(1000 * n + 500 + i, " ".join(w.upper() + "!!%%" for w in sentence(rng, 60).split()), lang) for i in range(10)]
        labels += [(1000 * n + i, 1, 0) for i in range(trusted)]
    docs.append((9000, "no trusted text in this language", "pl"))
    out = quality.quality(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert not any(r["keep"] for r in out if r["doc_id"] % 1000 >= 500)
    for lang in ("en", "de", "fr"):
        assert sum(r["keep"] for r in out if r["lang"] == lang and r["doc_id"] % 1000 < 500) >= 95
    assert [r["keep"] for r in out if r["lang"] == "pl"] == [True]


def test_quality_of_five_held_out_documents_and_whole_tags(spark):
    """A language with 25 trusted documents rejects junk; fil and fi, pt-BR and pt are languages of their own."""
    rng = random.Random(7)
    docs, labels = [], []
    for n, (lang, tag) in enumerate((("fi", "FI"), ("fil", " fil "), ("pt", "pt"), ("pt-br", "pt-BR"))):
        other = lambda m, n=n: "".join(chr(97 + (ord(c) - 97 + 3 * n) % 26) if c.isalpha() else c for c in sentence(rng, m))
        docs += [(1000 * n + i, other(60) + ".", tag) for i in range(60)]
        docs += [(1000 * n + 500 + i, " ".join(w.upper() + "!!%%" for w in other(60).split()), tag) for i in range(5)]
        docs += [(1000 * n + 600 + i, "word " * 7000 + other(20), tag) for i in range(1)]
        labels += [(1000 * n + i, 1, 0) for i in range(25)]
    docs += [(9000, "a lone trusted document", "is"), (9001, "another text", "is"), (9001, "the same id", "xx")]
    labels.append((9000, 1, 0))
    d = spark.createDataFrame([(*x, "y") for x in docs], "doc_id long, text string, lang string, level string").withColumn("s", F.lit(1)).withColumn("l", F.lit("z"))
    lab = spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, lang string")
    out = quality.quality(d, lab).collect()
    assert len(out) == len(docs) and {r["lang"] for r in out} == {"fi", "fil", "pt", "pt-br", "is", "xx"}
    assert not any(r["keep"] for r in out if 500 <= r["doc_id"] % 1000 < 600)
    assert all(sum(r["keep"] for r in out if r["lang"] == x and r["doc_id"] % 1000 < 500) >= 55 for x in ("fi", "fil", "pt", "pt-br"))
    assert all(r["keep"] and r["threshold"] is None for r in out if r["doc_id"] >= 9000)


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (9, 1, None), (None, 1, 1), (8, None, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    assert quality.quality(odd_docs, labels).filter("keep").count() == odd_docs.count()
    assert quality.quality(odd_docs, no_labels(spark)).count() == odd_docs.count()
    assert quality.quality(no_docs, labels).count() == 0


# --- substrings ---------------------------------------------------------------------------------------------------


def test_repeated_passages_are_caught(spark):
    rng = random.Random(7)
    other = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    passage = other(90)
    docs = [(i, f"{other(rng.randint(0, 80))} {passage.upper() if i == 2 else passage}\n{other(50)}") for i in range(5)] + [(i, other(200)) for i in range(5, 30)] + [(40, "same " * 200), (41, other(30))]
    line = other(9)
    docs += [(50 + i, f"{other(40)}\n{line}\n{other(40)}") for i in range(5)]
    out = chunks.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    # 40 repeats itself
    assert {r["doc_id"] for r in out} == {0, 1, 2, 3, 4, 40}
    text = dict(docs)
    for r in (r for r in out if r["doc_id"] < 40):
        got = text[r["doc_id"]].encode()[r["start"] : r["stop"]].decode()
        assert got.lower().strip() in passage and len(got.split()) >= 60
        assert r["kept"] == (r["doc_id"] == 0)


def test_each_chunk_keeps_one_copy(spark):
    rng = random.Random(8)
    other = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    licence, body, tail = other(40), other(80), other(60)
    # 5 and 7 are copies that open with the licence of 1; 6 and 8 open with a passage of their own and end with one of 2
    docs = {1: f"{licence}\n{other(30)}", 2: f"{other(20)}\n{tail}", 5: f"{licence}\n{body}", 7: f"{licence}\n{body}"}
    own = other(70)
    docs |= {6: f"{own}\n{tail}", 8: f"{own}\n{tail}"}
    left = {i: t.encode() for i, t in docs.items()}
    for r in sorted(chunks.repeated_passages(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect(), key=lambda r: -r["start"]):
        if not r["kept"]:
            left[r["doc_id"]] = left[r["doc_id"]][: r["start"]] + b"|" + left[r["doc_id"]][r["stop"] :]
    for passage, holder in ((licence, 1), (body, 5), (own, 6), (tail, 2)):
        middle = passage[80:-80].encode()
        assert [i for i, t in left.items() if middle in t] == [holder]
        assert not any(middle[20:60] in t for i, t in left.items() if i != holder)


def brute_passages(docs, least):
    """From the chunks of each document in turn: the first place of each digest, runs, and their parts by owner."""
    import pyarrow as pa

    found = {}
    for i, t in sorted(docs):
        d, _, words, start, stop = chunks.chunk_rows(*text_bytes(pa.array([t])))
        found[i] = list(zip(d.tolist(), words.tolist(), start.tolist(), stop.tolist(), strict=True))
    places = defaultdict(list)
    for i, cs in found.items():
        for n, c in enumerate(cs):
            places[c[0]].append((i, n))
    out = set()
    for i, cs in found.items():
        runs, run = [], []
        for n, c in enumerate(cs):
            if len(places[c[0]]) > 1:
                run.append((n, c, (places[c[0]][0][0], places[c[0]][0] == (i, n))))
            elif run:
                runs, run = [*runs, run], []
        for run in [*runs, run] if run else runs:
            words = sum(c[1] for _, c, _ in run)
            part = []
            for x in [*run, None]:
                if part and (x is None or x[2] != part[-1][2]):
                    out.add((i, part[0][1][2], part[-1][1][3], sum(c[1] for _, c, _ in part), words, *part[0][2]))
                    part = []
                part.append(x)
    return {r for r in out if r[4] >= least}


@pytest.mark.parametrize("least", [0, 28])
def test_passages_equal_brute_force(spark, least):
    rng = random.Random(21)
    other = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    p, q, line = other(90), other(70), other(22)
    # the tail of P before Q; P twice in a document; a line of 22 words in several; ties between whole copies
    docs = [(3, p), (9, f"{p} {q}"), (12, f"{p[200:]} {q}"), (14, f"{p}\n{other(30)}\n{p}"), (15, f"{q} {q}"), (20, other(40)), (30, other(40)), (31, "")]
    docs += [(40 + i, f"{other(20)}\n{line}\n{other(20)}") for i in range(5)] + [(60 + i, f"{line} {p}") for i in range(3)]
    out = chunks.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least).collect()
    assert {tuple(r) for r in out} == brute_passages(docs, least)
    left = {i: t.encode() for i, t in docs}
    for r in sorted(out, key=lambda r: -r["start"]):
        if not r["kept"]:
            left[r["doc_id"]] = left[r["doc_id"]][: r["start"]] + b"|" + left[r["doc_id"]][r["stop"] :]
    for passage, holder in ((p, 3), (q, 9)):
        assert [(i, t.count(passage[250:-80].encode())) for i, t in left.items() if passage[250:-80].encode() in t] == [(holder, 1)]


def test_repeats_inside_one_document(spark):
    rng = random.Random(22)
    other = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    p = other(90)
    text = f"{other(30)}\n{p}\n{other(30)}\n{p}\n{other(5)}"
    rows = spark.createDataFrame([(1, text, "x"), (1, text, "y"), (2, other(50), None), (5, other(60), None), (5, other(20) + p[:3], None)], "doc_id long, text string, first_doc string")
    out = sorted(chunks.repeated_passages(rows).collect(), key=lambda r: r["start"])
    assert [(r["doc_id"], r["kept"]) for r in out] == [(1, True), (1, False)]
    assert all(text.encode()[r["start"] : r["stop"]].decode().strip() in p for r in out)


def test_chunks_resist_insertions():
    import pyarrow as pa

    rng = random.Random(1)
    t = sentence(rng, 2000)
    data, off = text_bytes(pa.array([t, "insertion " + t, t[:3000] + " more words here " + t[3000:]]))
    d, row, _, start, stop = chunks.chunk_rows(data, off)
    a = set(d[row == 0])
    assert all(len(set(d[row == i]) & a) > 0.97 * len(a) for i in (1, 2))
    assert all((start[row == i][1:] >= stop[row == i][:-1]).all() for i in range(3))


def test_substring_odd(spark, odd_docs, no_docs):
    # of the odd texts only a word that is said 3000 times repeats anything
    out = chunks.repeated_passages(odd_docs).collect()
    assert {r["doc_id"] for r in out} == {ODD.index("word " * 3000)} and any(r["kept"] for r in out) and not all(r["kept"] for r in out)
    assert chunks.repeated_passages(no_docs).count() == 0
    twice = spark.createDataFrame([(1, " ".join(f"w{i * i}" for i in range(96)))] * 2, "doc_id long, text string")
    assert chunks.repeated_passages(twice).count() == 0


# --- near-duplicates ----------------------------------------------------------------------------------------------


def brute_groups(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(3, 120)).split() for _ in range(12)]
    docs = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            w[rng.randrange(len(w))] = rng.choice(VOCABULARY)
        docs.append((i * 3 % 1000, (" " if i % 2 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)))
    docs = list(dict(docs).items())
    out = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()
    want = brute_groups(docs, 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_many_weak_members_of_one_family(spark):
    """A family whose members are linked to few others: random meetings do not settle it, the rarest shingles do."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80)]
    docs = []
    for i in range(300):
        w = list(base)
        for _ in range(rng.randint(1, 8)):
            w[rng.randrange(80)] = f"q{rng.random()}"
        docs.append((i, " ".join(w)))
    out = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_groups(docs, 4, 80)


def family(n, seed=13):
    """Documents on one template: clusters of three by their own words, and within a cluster a few words of each."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]
    docs = []
    for c in range(n // 3):
        own = dict((i, word()) for i in rng.sample(range(100), 6))
        for j in range(3):
            w = [own.get(i, x) for i, x in enumerate(base)]
            w[rng.randrange(100)] = f"q{c}.{j}"
            docs.append((c * 3 + j, " ".join(w)))
    return docs


def test_family_of_many_small_components(spark):
    docs = family(240)
    out = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 80).collect()
    want = brute_groups(docs, 3, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert len({c for _, c in want.values()}) > 60


def test_meetings_grow_with_the_family_and_miss_nothing(spark):
    """Every similar pair of different components meets; five times the family makes no more than about five times the meetings."""
    counts = []
    for n in (120, 600):
        docs = family(n)
        sets = {i: (lambda w: {tuple(w[j : j + 3]) for j in range(len(w) - 2)})(t.split()) for i, t in docs}
        rows = spark.createDataFrame([(i, len(sets[i]), t) for i, t in docs], "doc_id long, n long, text string")
        groups = neardup.prefix_groups(rows, 3, 80).withColumn("c", F.col("node"))
        met = {(r["a"], r["b"]) for r in neardup.prefix_meetings(groups, 80).collect()}
        linked = {(a, b) for a in sets for b in sets if a < b and a // 3 == b // 3 and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
        assert linked <= met
        counts.append(len(met))
    assert counts[1] <= 8 * counts[0] + 200


def test_near_copies_of_one_text_meet_few_others(spark, monkeypatch):
    """A group of near copies: a member meets a few others, not new ones in each bucket, and the components are those of all pairs."""
    rng = random.Random(17)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    docs = []
    for i in range(240):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append((i, " ".join(w)))
    met, ordered = [], neardup._ordered

    def counted(*args):
        met.append(ordered(*args).count())
        return ordered(*args)

    monkeypatch.setattr(neardup, "_ordered", counted)
    out = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute_groups(docs, 4, 80)
    assert sum(met) <= 16 * len(docs), met


def test_prefixes_rank_shingles_once_for_repeated_rows(spark):
    """Sets that share 90 of 100 shingles share a key, also if each document stands in three rows."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(90)]
    rows = [(i, 100, " ".join(base + [word() for _ in range(10)])) for i in range(2)]
    found = neardup.prefix_groups(spark.createDataFrame(rows * 3, "doc_id long, n long, text string"), 1, 80).collect()
    once = neardup.prefix_groups(spark.createDataFrame(rows, "doc_id long, n long, text string"), 1, 80).collect()
    assert sorted(found) == sorted(once) and len(set(found)) == len(found) and min(r["p"] for r in found) == 11
    assert {r["key"] for r in found if r["node"] == 0} & {r["key"] for r in found if r["node"] == 1}


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    errors = []
    for n in (3, 40, 700):
        for share in (0.2, 0.5, 0.9):
            x = rng.integers(0, 2**63, 3 * n, dtype=np.int64).astype(np.uint64)
            m = int(n * share)
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[:m], x[n : 2 * n - m]]))
            s = neardup.superminhash([a, b])
            assert np.isfinite(s).all() and (s == neardup.superminhash([b, a])[::-1]).all()
            # each round is a permutation: integer parts of one element's values are all different
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(abs((s[0] == s[1]).mean() - j))
    assert max(errors) < 0.15
    one = np.floor(neardup.superminhash([np.array([5], np.uint64)])[0])
    assert sorted(one) == list(range(neardup.PLACES))


def test_bitmap_bound_never_rejects():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (set(rng.integers(0, 400, 200).tolist()) for _ in range(2))
        bits = [np.bincount(np.array(sorted(s)) % (64 * neardup.WORDS), minlength=64 * neardup.WORDS) & 1 for s in (a, b)]
        assert (bits[0] != bits[1]).sum() <= len(a ^ b)


def test_neardup_odd(spark, odd_docs, no_docs):
    out = neardup.near_duplicates(odd_docs, 4, 80).collect()
    assert len(out) == odd_docs.count() and all(r["kept"] for r in out)
    assert {r["n_shingles"] for r in out if r["doc_id"] in (0, 1, 2, 3)} == {0}
    assert neardup.near_duplicates(no_docs).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(500, i) for i in range(501, 600)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(250)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- decontamination ----------------------------------------------------------------------------------------------


def brute_hits(docs, items, n=10):
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, it in items:
            b = words(it)
            m = min(n, len(b))
            windows = {tuple(b[j : j + m]) for j in range(len(b) - m + 1)} if m else set()
            for j in range(len(w) - m + 1):
                if m and tuple(w[j : j + m]) in windows:
                    hit.update(range(j, j + m))
                    found.add(item)
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, sentence(rng, rng.choice([1, 4, 9, 10, 11, 30]))) for i in range(30)] + [(90, "the the the the the the the the the the the the"), (91, ""), (92, None), (93, "Été à l'école")]
    docs = []
    for i in range(80):
        w = sentence(rng, 40).split()
        for _ in range(rng.choice([0, 1, 2])):
            b = (rng.choice(items)[1] or "").split()
            at, s = rng.randrange(len(w)), rng.randrange(max(1, len(b) - 5))
            w[at:at] = b[s : s + 25]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 7 == 0 else " ".join(w)))
    docs += [(200, "the " * 50), (201, "Été à l'école!"), (202, "été à l'école"), (203, None), (204, "")]
    out = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in out} == brute_hits(docs, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in out)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "alpha beta x gamma delta"), (2, "alpha delta"), (3, "delta far from it all and then some more words alpha"), (4, "gamma")], "doc_id long, text string")
    got = {r["doc_id"] for r in decontaminate.proximity_matches(docs, items, 10, 2).collect()}
    assert 1 in got and 3 not in got and 4 not in got


@pytest.mark.parametrize("slop", [0, 3, 5])
def test_proximity_equals_brute_force(spark, slop):
    rng = random.Random(5)
    items = [(i, " ".join(rng.choice(VOCABULARY[:20]) for _ in range(rng.choice([1, 2, 6, 14])))) for i in range(12)]
    docs = [(i, " ".join(rng.choice(VOCABULARY[:24]) for _ in range(rng.choice([3, 20, 60])))) for i in range(40)]
    cf = Counter(w for _, t in docs for w in t.split())
    want = set()
    for item, t in items:
        w = t.split()
        n = min(10, len(w))
        for s in range(len(w) - n + 1):
            places = sorted((cf[x], s + o, x) for o, x in enumerate(w[s : s + n]))
            if places[0][0] == 0:
                continue
            for d, text in docs:
                x = text.split()
                at = [[p for p, y in enumerate(x) if y == z] for _, _, z in places[:2]]
                if n == 1 and at[0] or n > 1 and any(abs(q - p - (places[1][1] - places[0][1])) <= slop for p in at[0] for q in at[1]):
                    want.add((d, item))
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.proximity_matches(d, i, 10, slop).collect()} == want
    near = Counter(d for d, _ in want)
    assert {r["doc_id"]: r["n_near"] for r in decontaminate.contamination(d, i, 10, slop).collect()} == {d: near[d] for d, _ in docs}


def test_contamination_of_clashing_columns_and_shared_ids(spark):
    """Columns of the benchmark that clash, and rows that share a doc_id with different texts."""
    items = spark.createDataFrame([(1, "one two three", 5, "x"), (2, "four five", 6, "y")], "item_id long, text string, doc_id long, words string")
    docs = spark.createDataFrame([(7, "one two three", 1, "t"), (7, "four five six", 2, "t"), (7, "one two three", 3, "t"), (None, "four five", 4, "t")], "doc_id long, text string, pos long, term string")
    out = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.contamination(docs, items).collect())
    assert out == [(0, 2, 2, 1), (7, 3, 2, 1), (7, 3, 3, 1), (7, 3, 3, 1)]


def test_contamination_odd(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "zz zz"), (1, None), (None, "a")], "item_id long, text string")
    out = decontaminate.contamination(odd_docs, items).collect()
    assert len(out) == odd_docs.count()
    assert decontaminate.contamination(odd_docs, spark.createDataFrame([], "item_id long, text string")).filter("contaminated").count() == 0
    assert decontaminate.contamination(no_docs, items).count() == 0


# --- media --------------------------------------------------------------------------------------------------------


def test_media_formats():
    rng = np.random.default_rng(0)
    for h, w in ((1, 1), (3, 5), (8, 64), (17, 7)):
        rgb = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        assert (media.decode(media.encode_bmp(rgb)) == rgb).all()
        assert (media.decode(media.encode_netpbm(rgb)) == rgb).all()
        assert (media.decode(media.encode_netpbm(rgb[:, :, 0])) == rgb[:, :, 0]).all()
    assert (media.decode(b"P2 # c\n2 2\n255\n0 1\n2 255\n") == [[0, 1], [2, 255]]).all()
    assert (media.decode(b"P1\n3 1\n101\n") == [[0, 255, 0]]).all()
    assert (media.decode(b"P4\n3 1\n" + bytes([0b10100000])) == [[0, 255, 0]]).all()
    assert (media.decode(b"P5\n1 1\n65535\n\x01\x02") == [[258]]).all()
    for broken in (b"P5\n9 9\n255\nxx", b"GIF", b"P5\nx"):
        with pytest.raises(ValueError):
            media.decode(broken)


@pytest.mark.parametrize("size", [(1, 1), (4, 6), (5, 3), (20, 31)])
def test_area_resize_equals_definition(size):
    x = np.random.default_rng(1).integers(0, 256, (6, 9)).astype(float)
    h, w = size
    big = np.kron(x, np.ones((h, w)))
    want = big.reshape(h, x.shape[0], w, x.shape[1]).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(x, h, w), want)


def test_difference_hash_equals_definition():
    """Bit by bit from the mean luminance of each of the 9 x 8 areas."""
    rng = np.random.default_rng(3)
    for shape in ((8, 9), (16, 27, 3), (40, 18, 3)):
        x = rng.integers(0, 256, shape, dtype=np.uint8)
        grey = x.astype(float) if x.ndim == 2 else 0.299 * x[..., 0] + 0.587 * x[..., 1] + 0.114 * x[..., 2]
        h, w = shape[0] // 8, shape[1] // 9
        mean = [[grey[i * h : (i + 1) * h, j * w : (j + 1) * w].mean() for j in range(9)] for i in range(8)]
        bits = "".join("1" if round(mean[i][j], 6) < round(mean[i][j + 1], 6) else "0" for i in range(8) for j in range(8))
        assert media.difference_hash(x) == f"{int(bits, 2):016x}"


def test_media_columns(spark, odd_docs, no_docs, tmp_path):
    import io

    rows = media.media_columns(odd_docs, path=str(tmp_path / "store")).collect()
    assert len(rows) == odd_docs.count()
    # the stored tables are opened anew
    files, tiles = (spark.read.parquet(str(tmp_path / "store" / x)) for x in ("media", "tiles"))
    media_of = {r["doc_id"]: bytes(r["media"]) for r in files.collect()}
    assert sorted(map(str, rows)) == sorted(map(str, tiles.collect()))
    texts = dict(enumerate(ODD))
    for r in rows:
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        stored = media_of[r["doc_id"]]
        assert media.decode(stored).tobytes() == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        t = np.load(io.BytesIO(bytes(r["tile"])))
        assert t.dtype == np.uint8 and t.shape[:2] == (16, 16) and len(r["feature"]) == 16
        assert r["feature"] == media.difference_hash(media.decode(stored)) and r["tile_sha256"] == hashlib.sha256(bytes(r["tile"])).hexdigest()
    assert media.media_columns(no_docs).count() == 0


# --- toxicity -----------------------------------------------------------------------------------------------------


def toxic_corpus(rng, n):
    bad = ["grumblewort", "snarfing", "snarfed"]
    docs, labels = [], []
    for i in range(n):
        s = [sentence(rng, 8) for _ in range(rng.randint(2, 10))]
        y = i % 5 == 0
        if y:
            at = rng.randrange(len(s))
            s[at] = f"{s[at]} {rng.choice(bad)} {sentence(rng, 3)}"
        docs.append((i, ". ".join(s)))
        labels.append((i, 1, int(y)))
    return docs, labels, bad


def test_toxicity_on_held_out_rows(spark):
    docs, labels, bad = toxic_corpus(random.Random(9), 600)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab.filter(~toxicity.held_out()))
    rows = toxicity.score_documents(d, model).collect()
    text = dict(docs)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    for r in rows:
        if r["score"] >= 0.5:
            assert any(b in text[r["doc_id"]].encode()[r["worst_start"] : r["worst_end"]].decode() for b in bad)


def test_every_offending_sentence_is_found(spark):
    """Sentence by sentence from the definition: weights of the words and of the heads of longer words."""
    import pyarrow as pa

    docs, labels, bad = toxic_corpus(random.Random(4), 400)
    docs += [(900, f"One {bad[0]} here. Nothing there. And {bad[1]} {bad[2]}! End"), (901, "Plain words. Only plain words.")]
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(d, lab)
    rows = {r["doc_id"]: r for r in toxicity.score_documents(d, model).collect()}

    def probability(sentence):
        z = model.bias
        for w in re.findall(r"[a-z0-9\x80-\uffff]+", sentence.lower()):
            for h in (words_of(*text_bytes(pa.array([w])), toxicity.NOT_WORD)[0], *([mix64(words_of(*text_bytes(pa.array([w[:4]])), toxicity.NOT_WORD)[0] + np.uint64(1))] if len(w) > 4 else [])):
                z += model.weights[int(h[0] >> np.uint64(64 - toxicity.BITS))]
        return 1 / (1 + np.exp(-z))

    for i, text in [*docs[:60], *docs[-2:]]:
        spans, at = [], 0
        for piece in re.findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+$", text):
            spans.append((at, at + len(piece), probability(piece)))
            at += len(piece)
        want = [(a, b, p) for a, b, p in spans if p >= toxicity.OFFENDING]
        got = [tuple(x) for x in rows[i]["offending"]]
        assert [x[:2] for x in got] == [x[:2] for x in want] and np.allclose([x[2] for x in got], [x[2] for x in want], atol=1e-5)
        assert abs(rows[i]["score"] - (1 - np.prod([1 - min(p, 1 - 1e-9) for _, _, p in spans]))) < 1e-5
    assert len(rows[900]["offending"]) == 2 and not rows[901]["offending"]


def test_training_sample_is_bounded(spark):
    from lexweft.llm.common import labelled_texts

    docs = spark.createDataFrame([(i % 30, f"text {i} " * 10) for i in range(300)] + [(99, "x" * 50000), (None, "n")], "doc_id long, text string")
    known = spark.createDataFrame([(i, i % 2) for i in range(30)] + [(99, 1)], "doc_id long, y int")
    t = labelled_texts(docs, known, 20, 1000)
    ids = t["doc_id"].to_pylist()
    assert len(ids) == len(set(ids)) <= 20 and 99 not in ids and sum(len(x) for x in t["text"].to_pylist()) <= 1000
    assert labelled_texts(docs, known, 50, 10**6).num_rows == 31 and labelled_texts(docs, known.limit(0), 5, 5).num_rows == 0


def test_toxicity_odd(spark, odd_docs, no_docs):
    for labels in (no_labels(spark), spark.createDataFrame([(1, 1, 1), (4, 1, 0), (None, 0, 1), (8, 1, None)], "doc_id long, quality int, toxic int")):
        model = toxicity.train(odd_docs, labels)
        out = toxicity.score_documents(odd_docs, model).collect()
        assert len(out) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_documents(no_docs, model).count() == 0
    same = spark.createDataFrame([(1, "t x"), (2, "t x")], "doc_id long, text string")
    assert len({r["score"] for r in toxicity.score_documents(same, model).collect()}) == 1


# --- mixing -------------------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.4, 0.4], 400)
    rows = [(int(t), [float(x) for x in q]) for t, q in zip(rng.integers(1, 500, 400), p, strict=True)]
    m = spark.createDataFrame(rows, "n_tokens long, posterior array<double>").cache()
    weights = {"a": 0.7, "b": 0.2, "c": 0.1}
    steps = mixing.fit_rates(m, list("abc"), weights)
    rate = np.array([r["x"] for r in m.select(mixing._rate(steps).alias("x")).collect()])
    got = (p * (np.array([r[0] for r in rows]) * rate)[:, None]).sum(axis=0)
    assert (rate >= 0).all() and np.allclose(got / got.sum(), [0.7, 0.2, 0.1], atol=1e-4)


@pytest.mark.parametrize(("weights", "reachable"), [({"a": 0.9, "b": 0.08, "c": 0.02}, True), ({"a": 1.0}, False)])
def test_rates_equal_brute_force(spark, weights, reachable):
    """The nonnegative rates nearest to 1 that meet the targets, as very many small steps find them; a warning if none do."""
    import warnings

    rng = np.random.default_rng(4)
    p, t = rng.dirichlet([0.3, 0.3, 0.3], 200), rng.integers(1, 400, 200)
    m = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(t, p, strict=True)], "n_tokens long, posterior array<double>").cache()
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        steps = mixing.fit_rates(m, list("abc"), weights)
    rows = mixing.residuals(m, list("abc"), weights, steps)
    have, want, got = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    assert bool([w for w in said if "out of reach" in str(w.message)]) != reachable
    assert np.abs(got - want).max() <= (1e-6 * want.sum() if reachable else 0.5 * np.abs(have - want).max())
    if reachable:  # the optimum's conditions: steps that add up, and no rate but those at zero off the line
        rate = np.array([r["x"] for r in m.select(mixing._rate(steps).alias("x")).collect()])
        line = np.linalg.lstsq(p[rate > 0], 1 - rate[rate > 0], rcond=None)[0]
        assert np.allclose(rate, np.maximum(0, 1 - p @ line), atol=1e-6)


def test_targets_without_documents(spark):
    m = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.0]), (0, [0.0, 1.0])], "n_tokens long, posterior array<double>")
    with pytest.raises(ValueError, match="rare"):
        mixing.fit_rates(m, ["common", "rare"], {"common": 0.5, "rare": 0.5}, 100.0)
    steps = mixing.fit_rates(m, ["common", "rare"], {"common": 0.5, "rare": 0.5})
    assert [r["x"] for r in m.select(mixing._rate(steps).alias("x")).collect()] == [1.0, 1.0, 1.0]


def test_scarce_domains_do_not_cut_the_rest(spark):
    """Almost no junk is left: clean documents stay, a plentiful domain is cut to its share, the scarce one falls short."""
    rows = [(100, [0.999, 0.0005, 0.0005])] * 300 + [(100, [0.01, 0.98, 0.01])] * 40 + [(100, [0.05, 0.05, 0.9])]
    m = spark.createDataFrame(rows, "n_tokens long, posterior array<double>").cache()
    steps = mixing.fit_rates(m, ["clean", "toxic", "low_toxic"], {"clean": 0.96, "toxic": 0.02, "low_toxic": 0.02})
    rate = np.array([r["x"] for r in m.select(mixing._rate(steps).alias("x")).collect()])
    assert (rate[:300] > 0.97).all() and (rate[:300] < 1.03).all()
    assert rate[300:340].mean() < 0.3 and 0.5 < rate[340] < 1.5


def test_mix(spark, odd_docs, no_docs):
    docs, labels, _ = toxic_corpus(random.Random(2), 500)
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in mixing.mix(d, lab, {"clean": 0.98, "toxic": 0.02}).collect()}
    toxic = [r["rate"] for i, r in out.items() if i % 5 == 0]
    clean = [r["copies"] for i, r in out.items() if i % 5]
    assert np.mean(toxic) < 0.3 and np.mean([c > 0 for c in clean]) > 0.95
    assert mixing.mix(odd_docs, no_labels(spark)).count() == odd_docs.count()
    assert mixing.mix(odd_docs, lab).count() == odd_docs.count()
    assert mixing.mix(no_docs, lab).count() == 0


# --- HTML ---------------------------------------------------------------------------------------------------------


def page(body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{x}}</style><script>var t="</p><article>no</article>";</script></head><body>{body}</body></html>'


def test_html_main_text(spark):
    nav = "<nav><ul>" + "".join(f"<li><a href='/{i}'>menu {i}</a></li>" for i in range(5)) + "</ul></nav>"
    rows = [
        (1, "http://a.org/1", page(f"{nav}<div class='ad'>buy</div><article><h1>Head &amp; line</h1><p><b>One<br><p>Two  \n three&nbsp;x</p><div class=comments><p>nice</p></div></article><footer>&copy; x</footer><!-- <p>no</p> -->")),
        (2, "http://a.org/2", page(f"{nav}<article><p>Only</p><aside>no</aside><form>q<input></form></article>")),
        (3, "http://b.org/1", page("<div id='sidebar'>s</div><div><p>Body text one</p><p>same notice</p></div>")),
        (4, "http://b.org/2", page("<div><p>Other text</p><p>same notice</p></div>")),
        (5, "http://c.org/", "<p>cut <b>off</b"), (6, None, None), (7, "x", ""), (8, "http://c.org/", "plain & text &lt;x&gt;"), (8, "http://c.org/", "plain & text &lt;x&gt;"), (None, "http://d/", "<article><p>ü😀</p></article>"),
    ]
    got = defaultdict(list)
    for r in html.main_text(pages_of(spark, rows)).collect():
        got[r["page_id"]].append(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got[1] == ["Head & line\nOne\nTwo three x"] and got[2] == ["Only"]
    assert got[3][0].startswith("Body text one") and got[5] == ["cut off"] and got[6] == [""] and got[7] == [""]
    assert got[8] == ["plain & text <x>"] * 2 and got[None] == ["ü😀"]
    assert html.main_text(pages_of(spark, [])).count() == 0


def test_wrapper_has_options_and_groups(spark):
    rows = [(i, "http://a.org/x", page("<nav>m</nav>" * (i % 2) + "<article><h1>t</h1>" + f"<p>text {i}</p>" * (1 + i % 3) + "</article>")) for i in range(12)]
    w = html.wrappers(pages_of(spark, rows)).collect()
    assert len(w) == 1 and w[0]["n"] == 12 and w[0]["has_main"]
    assert "(<nav>#</nav>)?" in w[0]["wrapper"] and "(<p>#</p>)+" in w[0]["wrapper"]


def test_template_text_is_left_out_without_a_container(spark):
    rows = [(i, "http://a.org/x", page(f"<div class='x'>Welcome to the site</div><div class='y'>Story number {i}</div>")) for i in range(5)]
    assert {r["text"] for r in html.main_text(pages_of(spark, rows)).collect()} == {f"Story number {i}" for i in range(5)}


def test_wrapper_slots_tell_menus_from_content(spark):
    """A menu without marks is a repeated group of constant texts; the story's slots vary. Inside an article constant slots go too."""
    menu = "<div><ul><li>Home</li><li>News</li><li>About</li></ul></div>"
    rows = [(i, "http://a.org/x", page(f"{menu}<div><h2>Title {i}</h2><p>Story {i}</p>{'<p>More of it</p>' * (i % 2)}</div>")) for i in range(6)]
    rows += [(10 + i, "http://b.org/x", page(f"<article><span>x</span><div>Read it aloud</div><h1>Head {i}</h1><p>Text {i}</p><p>Licence</p></article>")) for i in range(4)]
    rows += [(20 + i, "http://c.org/x", page("<div>One</div><p>Two</p>")) for i in range(4)]  # copies of one page prove nothing
    got = {r["page_id"]: r["text"] for r in html.main_text(pages_of(spark, rows)).collect()}
    assert all(got[i] == f"Title {i}\nStory {i}" + "\nMore of it" * (i % 2) for i in range(6))
    assert all(got[10 + i] == f"Head {i}\nText {i}\nLicence" for i in range(4))
    assert all(got[20 + i] == "One\nTwo" for i in range(4))


def test_class_words_do_not_drop_articles(spark):
    body = "<article><h1>Head {0}</h1><p>Text {0}</p></article>"
    around = ["<div class='page no-sidebar'>{}</div>", "<div class='menu-open'>{}</div>", "<div class='menu'>{}</div>", "<form class='search'>{}</form>", "<div class='sidebar'><section>{}</section></div><div class='ad'>buy</div>", "{}<div class='related'><article>Another story</article></div>"]
    rows = [(i, f"http://h{i}.org/x", page(a.format(body.format(i)))) for i, a in enumerate(around)]
    rows.append((10, "http://k.org/x", page("").replace("<body>", f"<body class='has-sidebar menu'>{body.format(10)}")))
    rows.append((11, "http://l.org/x", page("<article class='post comments-open'><div class='article-header'><h1>Head 11</h1></div><p>Text 11</p><div class='comments'>nice</div></article>")))
    # all of the page in one marked element: the slots that vary are content
    rows += [(20 + i, "http://m.org/x", page(f"<div class='widget'><b>Site</b><div>Head {20 + i}</div><p>Text {20 + i}</p></div>")) for i in range(4)]
    for r in html.main_text(pages_of(spark, rows)).collect():
        assert r["text"] == "Head {0}\nText {0}".format(r["page_id"])


def test_alignment_is_a_generalisation():
    a = json.loads('[["ul",[["li",["#"],true,false]],false,false],"#"]')
    b = json.loads('[["ul",[["li",["#"],false,false]],false,false],["p",["#"],false,false],"#"]')
    assert html.expression(html.align(a, b)) == "<ul>(<li>#</li>)+</ul>(<p>#</p>)?#"
    assert html.align(a, a) == a


def test_alignment_against_brute_force(monkeypatch):
    """Small sequences: the longest common subsequence. At any size: both sequences match the wrapper."""
    rng = random.Random(31)

    def longest(x, y):
        return 0 if not x or not y else 1 + longest(x[1:], y[1:]) if x[0] == y[0] else max(longest(x[1:], y), longest(x, y[1:]))

    for table in (html.TABLE, 4):
        monkeypatch.setattr(html, "TABLE", table)
        for _ in range(150):
            x, y = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 9))] for _ in range(2))
            pairs = html.paired(x, y)
            assert all(x[i] == y[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
            assert table == 4 or len(pairs) == longest(x, y)
            nodes = [[[n, ["#"], False, False] for n in z] for z in (x, y)]
            pattern = re.compile(html.expression(html.align(*nodes)))
            assert all(pattern.fullmatch("".join(f"<{n}>#</{n}>" for n in z)) for z in (x, y))


def test_wide_pages_align_in_linear_memory():
    import time

    wide = lambda k: [[f"x{i * k}", ["#"], False, False] for i in range(40000)]
    began = time.perf_counter()
    out = html.align(wide(2), wide(3))
    assert len(out) == 2 * 40000 - len({2 * i for i in range(40000)} & {3 * i for i in range(40000)}) and time.perf_counter() - began < 20
    assert html.align([["a", ["#"], False, False], ["b", ["#"], False, False]] * 9000, [["b", ["#"], False, False]]) != []


def test_teasers_and_containers_with_marked_looks(spark):
    pages = [
        ('<body class="has-sidebar"><main><article><p>Alpha beta', "Alpha beta"),
        ('<article class="post comments-open"><h1>T</h1><p>Alpha beta', "T\nAlpha beta"),
        ('<div class="layout with-sidebar"><div class="text"><p>Alpha beta', "Alpha beta"),
        ('<article><p>One</p><div class="notice-board">Two</div><ul class="related-work"><li>Three</ul></article>', "One\nTwo\nThree"),
        ("<article><p>Teaser</p></article><div class='content'><p>" + "The real story. " * 20 + "</p></div>", "Teaser\n" + " ".join(["The real story."] * 20)),
    ]
    rows = spark.createDataFrame([(i, f"http://t{i}.org/", h, "x", 1) for i, (h, _) in enumerate(pages)], "page_id long, url string, html string, host string, slot int")
    assert {r["page_id"]: r["text"] for r in html.main_text(rows).collect()} == {i: t for i, (_, t) in enumerate(pages)}


def test_long_and_deep_pages():
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    slots, root = html.read_page(deep, tree=True)
    assert [s[3] for s in slots] == ["x"]
    assert html.content("<p>" + "w " * 100000, False, {}).count("w") == 100000
    assert html.content('<p a="unclosed>text</p><p>more</p>', False, {}) != ""


# --- sharding -----------------------------------------------------------------------------------------------------


def test_matrix_totals():
    counts = np.array([0, 5, 100, 1, 77, 0, 31])
    m = sharding.communication_matrix(counts, 5, 1)
    assert (m.sum(axis=1) == counts).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()
    mean = np.mean([sharding.communication_matrix(np.array([30, 30]), 3, s)[0] for s in range(400)], axis=0)
    assert np.allclose(mean, 10, atol=0.6)


def test_shards(spark, odd_docs, no_docs):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy")).otherwise(F.concat(F.lit("é"), F.col("id").cast("string"))).alias("text"), F.lit("e").alias("extra"))
    for payload in (False, True):
        rows = sharding.shard_documents(docs, 24, payload).collect()
        assert sorted(r["doc_id"] for r in rows) == list(range(2000))
        n = Counter(r["shard"] for r in rows)
        assert set(n) == set(range(24)) and max(n.values()) - min(n.values()) <= 1
        for s in range(24):
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n[s]))
        for r in rows[:50]:
            t = "copy" if r["doc_id"] % 3 == 0 else f"é{r['doc_id']}"
            assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None)
    # no trace of the order of ids
    first = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(first, range(2000))[0, 1]) < 0.1
    odd = sharding.shard_documents(odd_docs, 24).collect()
    assert len(odd) == odd_docs.count() and all(r["size"] >= 8 for r in odd)
    assert sharding.shard_documents(no_docs, 24).count() == 0


def test_plan_of_native_operators_has_no_python(spark, small):
    for op in (decontaminate.op5, sharding.op10):
        plan = op(spark, small)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_large_urns_are_drawn_exactly(monkeypatch):
    """The weights around the mode are the hypergeometric probabilities, and draws from them have their mean and spread."""
    from math import comb

    for good, bad, n in ((30, 70, 20), (5, 500, 60), (400, 3, 200), (1, 1, 1)):
        ks, w = sharding._around_mode(good, bad, n)
        exact = np.array([comb(good, int(k)) * comb(bad, n - int(k)) / comb(good + bad, n) for k in ks])
        assert np.allclose(w / w.sum(), exact, rtol=1e-9, atol=1e-15) and abs(exact.sum() - 1) < 1e-9
    rng = np.random.default_rng(1)
    good, bad, n = 4 * 10**9, 6 * 10**9, 10**5
    x = np.array([sharding._hypergeometric(rng, good, bad, n) for _ in range(3000)])
    assert abs(x.mean() - n * 0.4) < 4 * (n * 0.24 / 3000) ** 0.5 and abs(x.std() / (n * 0.24) ** 0.5 - 1) < 0.06
    monkeypatch.setattr(sharding, "URN", 0)
    m = sharding.communication_matrix(np.array([50, 0, 7, 43]), 6, 3)
    assert (m.sum(axis=1) == [50, 0, 7, 43]).all() and m.sum(axis=0).max() - m.sum(axis=0).min() <= 1 and (m >= 0).all()


def test_shuffle_of_equal_rows_and_clashing_columns(spark):
    """Rows without any difference are dealt like others, each row of a partition with equal chances for each shard."""
    same = spark.range(700).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("x").alias("size"), F.lit(1).alias("__lw_x"), F.lit(5).alias("shard"))
    for payload in (False, True):
        rows = sharding.shard_documents(same, 7, payload).collect()
        assert Counter(r["shard"] for r in rows) == {i: 100 for i in range(7)} and {r["size"] for r in rows} == {8}
        assert all(sorted(r["slot"] for r in rows if r["shard"] == i) == list(range(100)) for i in range(7))
    parts = spark.range(0, 900, 1, 9).withColumn("p", F.spark_partition_id())
    rows = [r for s in range(12) for r in sharding.hypergeometric_shuffle(parts, 3, s).collect()]
    cells = Counter((r["p"], r["shard"]) for r in rows)
    assert all(abs(cells[p, s] - 400) < 100 for p in range(9) for s in range(3))
    low = np.mean([r["slot"] for r in rows if r["id"] < 100])
    assert abs(low - 149.5) < 15


def test_shuffle_exchanges_rows_once(spark, small):
    plan = sharding.shard_documents(spark.read.parquet(f"{small}/documents.parquet"), payload=True)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(shard", plan)) == 1
