from pyspark.sql import functions as F

from lexweft.operators import evaluate, expand, extract, merge, rank
from lexweft.plans.config import LinkConfig
from lexweft.plans.link import evaluate_job, link, link_text, report
from lexweft.sources import caches, pubtator, terminology

ENTITIES = [
    ("D009369", "neoplasms", ["neoplasms", "cancer", "tumor"], "New abnormal growth of tissue", ["C04"]),
    ("D008175", "lung neoplasms", ["lung neoplasms", "cancer of the lung", "lung cancer"], "Tumors of the lung", ["C04.588.894", "C08.785"]),
    ("D009203", "myocardial infarction", ["myocardial infarction", "heart attack"], "necrosis of the myocardium", ["C14.280"]),
    ("D001241", "aspirin", ["aspirin", "acetylsalicylic acid"], "an analgesic", ["D02.455"]),
]
KB = "entity_id string, preferred_label string, synonyms array<string>, definition string, tree_numbers array<string>"
DOCS = "doc_id long, title string, text string"
TEXT = "cancer of the lung is a serious disease. Patients had myocardial infarction (MI). MI and aspirin."


def test_mentions(spark):
    docs = spark.createDataFrame([(1, "cancer of the lung is a serious disease"), (2, "She is having a fever and her temperature is around 39"), (3, "3-methoxy-4-hydroxy acid"), (4, ""), (5, None)], "doc_id long, text string")
    got = {}
    for r in extract.mentions(extract.tokens(docs), docs).collect():
        got.setdefault(r["doc_id"], []).append((r["mention"], r["start"], r["end"]))
    assert sorted(got[1], key=lambda x: x[1]) == [("cancer of the lung", 0, 18), ("disease", 32, 39)]
    assert sorted(x[0] for x in got[2]) == ["fever", "temperature"]
    assert got[3] == [("3-methoxy-4-hydroxy acid", 0, 24)]
    assert 4 not in got and 5 not in got


def test_link_text(spark):
    ents, docs = spark.createDataFrame(ENTITIES, KB), spark.createDataFrame([(1, "Lung cancer", TEXT)], DOCS)
    got = {r["mention"]: r for r in link_text(docs, ents)["result"].collect()}
    assert got["cancer of the lung"]["entity_id"] == "D008175"
    assert got["MI"]["entity_id"] == "D009203" and got["aspirin"]["entity_id"] == "D001241"


def test_link_with_model_and_report(spark):
    ents, docs = spark.createDataFrame(ENTITIES, KB), spark.createDataFrame([(1, "Lung cancer", TEXT)], DOCS)
    m = spark.createDataFrame([(1, 1, "lung cancer", "Disease"), (2, 1, "aspirn", "Chemical"), (3, 9, "heart attack", None)], "mention_id long, doc_id long, mention string, entity_type string")
    phases = link(m, docs, ents, LinkConfig(use_model=True), client=lambda: (lambda p: "2"))
    got = {r["mention_id"]: r for r in phases["result"].collect()}
    assert got[1]["chosen_rank"] == 2 and got[1]["confidence"] == "llm" and got[1]["phase3_top1"] == "D008175"
    gold = evaluate.expanded_gold(spark.createDataFrame([(1, "D008175"), (2, "D001241|X"), (3, "D009203")], "mention_id long, gold_id string"), spark.createDataFrame([], "id string, alias_id string"))
    out = report(phases, m, gold, (1, 5))
    assert [r["accuracy"] for r in out["accuracy_ranked"].orderBy("k").collect()] == [100.0, 100.0]


def test_rerank_case(spark):
    c = [("C000702033", 79.1, 0, ["B01"], ""), ("D012595", 75.0, 1, ["C05"], ""), ("D007674", 50.0, 2, ["C12"], "renal and kidney disorders of any kind")]
    rows = spark.createDataFrame([(1, e, s, o, "renal sclerosis", "Disease", "renal and kidney function in scleroderma", d, t, {"D012595": 1, "D007674": 3}.get(e)) for e, s, o, t, d in c], "mention_id long, entity_id string, score double, ord int, mention string, entity_type string, context string, definition string, tree_numbers array<string>, n_sources int")
    got = {r["entity_id"]: (round(r["new_score"], 1), r["new_rank"]) for r in rank.rerank(rows).collect()}
    assert got == {"D012595": (77.0, 1), "D007674": (60.8, 2), "C000702033": (49.1, 3)}


def test_merges_differ(spark):
    s = "mention_id long, entity_id string, score double, ord int, origin string"
    a, b = spark.createDataFrame([(1, "x", 50.0, 0, "a"), (1, "y", 40.0, 1, "a")], s), spark.createDataFrame([(1, "y", 90.0, 0, "b"), (1, "z", 60.0, 1, "b")], s)
    order = lambda df: [r["entity_id"] for r in df.orderBy("ord").collect()]
    assert order(merge.append_if_absent(a, b)) == ["x", "y", "z"]
    assert order(merge.keep_best(a, b)) == ["y", "z", "x"]


def test_tree_prefixes(spark):
    row = spark.range(1).select(expand.tree_prefixes(F.lit("C04.588.614")).alias("a"), expand.tree_prefixes(F.lit("C04")).alias("b")).first()
    assert row["a"] == ["C04", "C04.588"] and row["b"] == []


def test_pubtator_file(spark, tmp_path):
    text = "1|t|Title é\r\n1|a|Abstract\r\n1\t0\t5\tTitle\tDisease\tD1\r\n1\t0\t5\tTitle\tDisease\t\r\n1\tAssoc\tD1\tD2\tNovel\r\n1\tAssoc\tD1\tD2\r\n1\tx\t5\tb\tT\tD3\r\n\r\n2|t|B\r\n2\t0\t1\tB\tChemical\t-1\r\n"
    (tmp_path / "a.txt").write_bytes(text.encode())
    meta, ann, rel = pubtator.read(spark, str(tmp_path / "a.txt"))
    assert {tuple(r) for r in meta.collect()} == {("1", "Title é", "Abstract"), ("2", "B", "")}
    assert [(r["mention"], r["mesh_id"], r["start"]) for r in ann.orderBy("ann_ord").collect()] == [("Title", "D1", 0), ("B", "-1", 0)]
    assert sorted(((r["relation_type"], r["novelty"]) for r in rel.collect()), key=repr) == [("Assoc", "Novel"), ("Assoc", None)]
    pubtator.save({"metadata": meta, "annotations": ann, "relations": rel}, str(tmp_path / "csv"))
    back = pubtator.load(spark, str(tmp_path / "csv"))
    assert back["annotations"].count() == 2 and {tuple(r) for r in back["metadata"].fillna("").collect()} == {("1", "Title é", "Abstract"), ("2", "B", "")}
    assert evaluate.linkable(ann, "bc5cdr").count() == 1


def test_mesh_xml(spark, tmp_path):
    (tmp_path / "d.xml").write_text(
        "<Set><DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>One</String></DescriptorName><TreeNumberList><TreeNumber>C01</TreeNumber><TreeNumber>C02</TreeNumber></TreeNumberList>"
        "<ConceptList><Concept><ScopeNote> note </ScopeNote><TermList><Term><String>One</String></Term><Term><String>Uno</String></Term></TermList></Concept></ConceptList></DescriptorRecord>"
        "<DescriptorRecord><DescriptorUI>D2</DescriptorUI><DescriptorName><String>Two</String></DescriptorName><ConceptList><Concept><TermList><Term><String>Two</String></Term></TermList></Concept></ConceptList></DescriptorRecord></Set>"
    )
    (tmp_path / "s.xml").write_text("<Set><SupplementalRecord><SupplementalRecordUI>D2</SupplementalRecordUI><SupplementalRecordName><String>Zwei</String></SupplementalRecordName><ConceptList><Concept><TermList><Term><String>Zwei</String></Term></TermList></Concept></ConceptList></SupplementalRecord></Set>")
    got = {r["entity_id"]: r for r in terminology.mesh(spark, str(tmp_path / "d.xml"), str(tmp_path / "s.xml")).collect()}
    assert got["D1"]["synonyms"] == ["One", "Uno"] and got["D1"]["definition"] == "note" and got["D1"]["tree_numbers"] == ["C01", "C02"]
    assert got["D2"]["preferred_label"] == "Zwei" and got["D2"]["tree_numbers"] == []


def test_caches_and_requests(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert caches.cached(spark, str(tmp_path / "c"), build, "model").count() == 3
    assert built == [1]
    assert caches.requests(spark, ["a", {"text": "b", "entity_type": "T"}]).collect()[1]["entity_type"] == "T"
    (tmp_path / "x.json").write_text('{"D1": ["a", "b"]}')
    assert terminology.read_synonym_cache(spark, str(tmp_path / "x.json")).count() == 2


def test_stream(spark, tmp_path):
    import json

    from lexweft.streaming.link_stream import link_stream, read_documents

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"doc_id": 1, "title": "Lung cancer", "text": TEXT}))
    ents = spark.createDataFrame(ENTITIES, KB)
    q = link_stream(read_documents(spark, str(tmp_path / "in")), ents, str(tmp_path / "out"), str(tmp_path / "cp"), LinkConfig(use_expansion=False, use_topics=False))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("entity_id = 'D008175'").count() == 1


def test_blocks_of_queries_change_nothing(spark, monkeypatch):
    from lexweft.operators import retrieve

    names = [f"{a} {b}" for a in ("red", "blue", "small", "old") for b in ("bolt", "ring", "gear")]
    labels = spark.createDataFrame([(i, n, n, i) for i, n in enumerate(names)], "entity_id long, label string, label_norm string, label_ord long")
    q = spark.createDataFrame([(n[1:],) for n in names] + [(None,), ("",)], "mention string")
    for find in (retrieve.fuzzy_topk, retrieve.difflib_topk):
        one = sorted(map(tuple, find(q, labels, 2).collect()))
        with monkeypatch.context() as m:
            m.setattr(retrieve, "BLOCK", 5)
            assert sorted(map(tuple, find(q, labels, 2).collect())) == one
        assert len(one) == 26


def test_dense_index(spark):
    from lexweft.operators import dense

    load, wide = dense.hashed_trigrams(), dense.hashed_trigrams(128)
    ents = spark.createDataFrame([(1, "lung cancer", ["Lung Cancer", "pulmonary carcinoma"]), (2, "aspirin", ["asa"]), (3, "heart attack", [])], "entity_id long, preferred_label string, synonyms array<string>")
    index = dense.build_index(ents, load)
    assert index.count() == 5
    q = spark.createDataFrame([(7, "Aspirin"), (8, "heart attacks"), (9, None)], "query long, mention string")
    got = {r["query"]: r["entity_id"] for r in dense.retrieve_with({"a": (index, load), "b": (dense.build_index(ents, wide), wide)}, q, 1).orderBy("max_score").collect()}
    assert got[7] == 2 and got[8] == 3
    c = spark.createDataFrame([(1, "lung cancer", "lung cancer"), (2, "lung cancer", "aspirin")], "mention_id long, mention string, preferred_label string")
    assert [round(r["dense"]) == 100 for r in dense.score_candidates(c, load).orderBy("mention_id").collect()] == [True, False]


def test_dense_branch_finds_and_rescores(spark):
    from lexweft.operators import dense

    ents, docs = spark.createDataFrame(ENTITIES, KB), spark.createDataFrame([(1, "Lung cancer", TEXT)], DOCS)
    m = spark.createDataFrame([(1, 1, "myocardial infarct", "Disease")], "mention_id long, doc_id long, mention string, entity_type string")
    config = LinkConfig(use_dense=True, top_k=2, use_expansion=False, use_rules=False, use_topics=False)
    phases = link(m, docs, ents, config, encoder=dense.hashed_trigrams())
    plain, mixed = ({r["entity_id"]: r for r in phases[p].collect()} for p in ("search", "dense"))
    assert set(plain) <= set(mixed) and mixed["D009203"]["ord"] == 0
    scored = dense.score_candidates(spark.createDataFrame([("myocardial infarct", "myocardial infarction")], "mention string, preferred_label string"), dense.hashed_trigrams()).first()["dense"]
    assert abs(mixed["D009203"]["score"] - (0.7 * plain["D009203"]["score"] + 0.3 * scored)) < 1e-6
    try:
        link(m, docs, ents, config)
        raise AssertionError
    except ValueError:
        pass


def test_evaluation_by_id_and_by_concept(spark, tmp_path):
    ents, docs = spark.createDataFrame(ENTITIES, KB), spark.createDataFrame([(1, "Lung cancer", TEXT)], DOCS)
    rows = [(1, "lung cancer", "Disease", "UMLS:C1", 0), (1, "aspirin", "Chemical", "UMLS:C2", 1), (1, "aspirin", "Chemical", "UMLS:C2", 2), (1, "unmapped", "Disease", "UMLS:C9", 3)]
    ann = spark.createDataFrame(rows, "doc_id long, mention string, entity_type string, mesh_id string, ann_ord long")
    cuis = spark.createDataFrame([("C1", "D008175"), ("C2", "D001241"), ("C2", "D999")], "cui string, entity_id string")
    config = LinkConfig(use_expansion=False, use_rules=False, use_topics=False)
    out = evaluate_job(docs, ann, ents, "medmentions", config, cui_map=cuis, log=str(tmp_path / "log"))
    at = lambda o: {r["k"]: (r["hits"], r["total"]) for r in o["accuracy_ranked"].collect()}
    assert at(out)[1] == (2, 2)
    assert spark.read.json(str(tmp_path / "log" / "accuracy_ranked")).count() == 5
    by = ents.join(cuis.dropDuplicates(["cui"]), "entity_id").drop("entity_id").withColumnRenamed("cui", "entity_id")
    assert at(evaluate_job(docs, ann, by, "medmentions", config, by_concept=True))[1][1] == 3
    assert at(evaluate_job(docs, ann, by, "medmentions", config, cui_map=cuis, by_concept=True, limit=1))[1] == (1, 1)


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.txt").write_text("1|t|old\n")
    (tmp_path / "p" / "b.txt").write_text("1|t|new\n" + "".join(f"{i}|t|T{i}\n" for i in range(2, 400)))
    lines = pubtator.read_lines(spark, str(tmp_path / "p"))
    assert [r["value"] for r in lines.orderBy("ord").limit(3).collect()] == ["1|t|old", "1|t|new", "2|t|T2"]
    assert {r["title"] for r in pubtator.parse(lines)[0].filter("pmid = '1'").collect()} == {"new"}


def test_caches_of_names_copies_and_times(spark, tmp_path):
    names = spark.createDataFrame([("D1", "b"), ("D1", "a"), ("D1", "a"), ("D2", "c")], "entity_id string, name string")
    caches.save_synonyms(names, str(tmp_path / "s"))
    assert sorted(map(tuple, caches.load_synonyms(spark, str(tmp_path / "s")).collect())) == [("D1", "a"), ("D1", "b"), ("D2", "c")]
    asked = []
    for _ in range(2):
        assert caches.raw_copy(spark, str(tmp_path / "raw"), lambda: asked.append(1) or "{\"x\": 1}").first()["value"].strip() == '{"x": 1}'
    assert asked == [1]
    (tmp_path / "f").write_text("1")
    one = caches.source_key(spark, str(tmp_path / "f"))
    (tmp_path / "f").write_text("12")
    assert caches.source_key(spark, str(tmp_path / "f")) != one


def test_gold_by_concept_in_blocks(spark, monkeypatch):
    """Aliases by blocks of a concept equal the plain join; ids in several shared concepts, null ids and hot concepts count once."""
    from lexweft.operators import evaluate

    rows = [("hot", f"h{i}") for i in range(40)] + [("c2", f"h{i}") for i in range(0, 40, 2)] + [("c3", "x"), ("c3", "h0"), ("c3", None), (None, "x"), ("c3", "x")]
    concepts = spark.createDataFrame(rows, "concept string, id string")
    m = spark.createDataFrame([(1, "h1|h2"), (2, "h4,h6|x"), (3, "none"), (4, None), (5, "x|"), (1, "h2|h8")], "mention_id long, gold_id string")
    pairs = {(a, b) for ca, a in rows for cb, b in rows if ca and ca == cb and a and b and a != b}
    gold = {(i, p) for i, g in m.collect() for p in (g or "").split("|") if p}
    gold |= {(i, b) for i, p in gold for a, b in pairs if a == p}
    monkeypatch.setattr(evaluate, "ALIAS_BLOCK", 7)
    got = [tuple(r) for r in evaluate.aliases(concepts).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    got = [tuple(r) for r in evaluate.gold_by_concept(m, concepts).collect()]
    assert len(got) == len(set(got)) and set(got) == gold
    # no join or exchange carries pairs: hot ids meet in at least as many tasks as the pairs ask for
    monkeypatch.setattr(evaluate, "PAIRS_PER_TASK", 100)
    assert evaluate.aliases(concepts.filter("concept = 'hot'")).rdd.getNumPartitions() >= 16


def test_bridge_by_concept_equals_the_table(spark, monkeypatch):
    """Mentions that meet entities by concept get the rows of the bridge table, with shared concepts and candidates left out."""
    from lexweft.operators import evaluate, expand

    names = spark.createDataFrame([("a", "Heart Attack "), ("b", "heart attack"), ("c", "Stroke"), ("b", "mi"), ("c", "heart attack"), ("d", None)], "cui string, name string")
    reached = spark.createDataFrame([("a", list(range(30))), ("b", list(range(20, 45))), ("c", [3, 50, 51]), ("d", [60])], "cui string, ids array<long>")
    mentions = spark.createDataFrame([(1, "Heart attack"), (2, " stroke"), (3, "mi"), (4, None), (5, "heart ATTACK")], "mention_id long, mention string")
    have = spark.createDataFrame([(1, 25), (2, 3), (9, 1)], "mention_id long, entity_id long")
    known = spark.createDataFrame([(i,) for i in range(60) if i % 7] * 2, "entity_id long")
    monkeypatch.setattr(evaluate, "ALIAS_BLOCK", 8)
    want = sorted(map(tuple, expand.bridge_expansion(mentions, expand.name_bridge(names, reached), have, known).collect()))
    assert sorted(map(tuple, expand.bridge_by_concept(mentions, names, reached, have, known).collect())) == want and len(want) > 70


def test_extract_by_document_equals_the_windows(spark, monkeypatch):
    """Spans found document by document equal the windows over tokens, on odd texts and in small slices."""
    import random

    from lexweft.operators import extract

    rng = random.Random(4)
    bits = ["the", "of", "heart", "Attack", "was", "treated", "-", "3.5", "12", ",", "3", ".", "!", "?", "in", "aspirin's", "naïve", "β-blocker", "…", "«", "»", "$", "+", "ſ", "KING", "running", "é", "٣", "𝒳", "。", "؝"]
    gaps = [" ", " ", " ", "", "\n", "  ", " ", " ", "\x1c", "　", "\x85"]
    texts = ["".join(rng.choice(bits) + rng.choice(gaps) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    docs = spark.createDataFrame([*enumerate([*texts, "", " ", None, "  leading of the end ", "3 - 4", "a-b - c", "pain in the left arm."])], "doc_id long, text string")
    want = sorted(map(tuple, extract.mentions(extract.tokens(docs), docs).collect()))
    monkeypatch.setattr(extract, "SLICE", 50)
    got = extract.extract(docs)
    assert got.columns == ["doc_id", "start", "end", "mention"]
    assert sorted(map(tuple, got.collect())) == want and len(want) > 1000


def test_reach_without_a_table_of_relations(spark, monkeypatch):
    """Ids in one hop or two equal plain Python, and no distinct table of both directions of the relations is made for them."""
    import random

    from lexweft.operators import expand

    rng = random.Random(8)
    rel = [(f"c{rng.randint(0, 40)}", rng.choice(["PAR", "CHD", "RB", "RN", "SY"]), f"c{rng.randint(0, 40)}") for _ in range(60)]
    rel += [("hub", "PAR", f"m{i}") for i in range(9)] + [("far", "RB", "hub"), ("far", "RB", "hub"), (None, "PAR", "m1"), ("n", "PAR", None)]
    ids = [(f"m{i}", 100 - i) for i in range(9)] + [("c3", 7), ("c3", 8), ("c9", 1), ("c20", 5)]
    edges = {e for a, r, b in rel if a and b and r != "SY" for e in ((a, r in ("PAR", "RB"), b), (b, r in ("CHD", "RN"), a))}
    of, want = {c: {i for d, i in ids if d == c} for c, _ in ids}, {}
    for c in {a for a, _, _ in edges} - set(of):
        found = {i for a, _, b in edges if a == c for i in of.get(b, ())}
        found = found or {i for a, u, m in edges if a == c and u for x, v, b in edges if x == m and v for i in of.get(b, ())}
        if found:
            want[c] = sorted(found)[:4]

    def table(_):
        raise AssertionError("relations made distinct")

    monkeypatch.setattr(expand, "both_ways", table)
    got = expand.reachable(spark.createDataFrame(rel, "cui1 string, rel string, cui2 string"), spark.createDataFrame(ids, "cui string, entity_id long"), 4).collect()
    assert {r["cui"]: r["ids"] for r in got} == want and len(got) == len(want) and "far" in want
