from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexweft.functions import abbrev, answers, similarity, text


def one(spark, expr, **cols):
    return spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} string" for k in cols)).select(expr.alias("x")).first()["x"]


def test_variants(spark):
    v = lambda s: one(spark, text.variants("t"), t=s)
    assert v("Crohn's disease") == ["Crohn's disease", "Crohn disease"]
    assert v("TNF-α") == ["TNF-α", "TNF-alpha", "TNFα", "TNF α"]
    assert v("seizures") == ["seizures", "seizure"]
    assert v("Type II diabetes") == ["Type II diabetes", "Type II diabete", "Type 2 diabetes"]
    assert v("aspirin (oral)") == ["aspirin (oral)", "aspirin"]


def test_abbreviation_look(spark):
    seen = {s: one(spark, text.likely_abbreviation("t"), t=s) for s in ("AMI", "all", "ALL", "x", "T2DM", "interleukin", "IL-2", "aB", "abcd1", None)}
    assert seen == {"AMI": True, "all": False, "ALL": False, "x": False, "T2DM": True, "interleukin": False, "IL-2": True, "aB": True, "abcd1": True, None: False}
    for s, v in seen.items():
        if s:
            assert abbrev.looks_short(s) == v


def test_definitions():
    assert abbrev.definitions("Patients with acute myocardial infarction (AMI) died")["AMI"] == ("AMI", "acute myocardial infarction", "parenthetical")
    assert abbrev.definitions("(AMI) acute myocardial infarction")["AMI"][1:] == ("acute myocardial infarction", "reverse_parenthetical")
    assert "DOG" not in abbrev.definitions("a red fox (DOG)")
    assert abbrev.letters_match("NSCLC", "non small cell lung cancer") and not abbrev.letters_match("NSCLC", "non-small cell lung cancer")
    assert abbrev.letters_match("A" * 40, " ".join(["a"] * 60)) is False  # filler words only, and no exponential search


def test_parse_choice(spark):
    c = lambda s, n=5: one(spark, text.choice("t", n), t=s)
    assert [c(s) for s in ("…reason…\n3", "NONE", "99", "<think>2</think> 4", "choose 2 or 3", "", None, "1 then\nno digits")] == [3, None, None, 4, 2, None, None, 1]


def test_answers(spark):
    def found(f, texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", f("t").alias("x")).collect()
        return {r["t"]: r["x"] for r in rows}

    cases = {
        "AMI stands for acute myocardial infarction.": "acute myocardial infarction",
        "<think>hm</think>\n**acute myocardial infarction**": "acute myocardial infarction",
        "UNKNOWN.": None, "I don't know": None, "": None, None: None, "ab": None, "NONE": None, "x" * 101: None,
        '"quoted term"': "quoted term", "'it'": None,
        "Answer: chronic kidney disease": "chronic kidney disease",
        "The full form is chronic kidney disease": "chronic kidney disease",
        "The abbreviation is common.\nCKD refers to 'chronic kidney disease'.\nBye": "chronic kidney disease",
        "In this context it is rare.\nchronic kidney disease.\nMore text": "chronic kidney disease",
        "1) see\n" + "long " * 30 + "\n2) renal failure": "2) renal failure",
        "Expansion: **renal failure**": "renal failure",
    }
    assert found(answers.parse_expansions, cases) == cases
    cases = {
        "1. Analyze\nAnswer: chronic kidney disease": "chronic kidney disease",
        "Thinking Process:\n3. Conclusion: renal failure.": "renal failure",
        "so → first\nso → *second one*.": "second one",
        "renal failure\nStep two\n* a bullet\nTherefore": "renal failure",
        "Answer: unknown\nrenal **failure** now": "renal failure now",
        "the **acute phase**": "acute phase",
        "": None, None: None, "- x\nInput": None,
    }
    assert found(answers.answers_in_reasoning, cases) == cases


def test_trimming():
    t = abbrev.trim_long_form
    assert t("AMI", "Patients with acute myocardial infarction") == "acute myocardial infarction"
    assert t("PD", "Parkinson disease was diagnosed in") == "Parkinson disease"
    assert t("SSRIs", "selective serotonin reuptake inhibitors") == "selective serotonin reuptake inhibitors"
    assert t("QZ", "nothing in here fits it") == "nothing in here fits it"


def test_windows(spark):
    t = "One here. Two mention here! Three? Four. Five."
    assert one(spark, text.mention_window("t", F.lit("MENTION"), 1), t=t) == "One here. Two **mention** here! Three?"
    assert one(spark, text.mention_window("t", F.lit("absent")), t=t) == t
    assert one(spark, text.sentence_snippet("t", F.lit("absent"), 7), t=t) == t[:7]


word = st.text(alphabet="abcdeé ", max_size=70)


@settings(max_examples=150, deadline=None)
@given(word, st.lists(word, min_size=1, max_size=6))
def test_lcs_block_equals_table(query, labels):
    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            prev = row
            row = [0]
            for j, y in enumerate(b):
                row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[-1]))
        return row[-1]

    assert list(similarity.LabelBlock(labels).lcs(query)) == [lcs(query, x) for x in labels]


def test_three_forms_of_the_ratio_agree(spark):
    pairs = [("blue bolt", "bolt blu"), ("", ""), ("a", ""), ("cancer of the lung", "lung cancer"), ("x" * 70, "x" * 60)]
    df = spark.createDataFrame(pairs, "a string, b string")
    key = lambda c: similarity.token_sort_key(F.col(c))
    native = similarity.indel_ratio(similarity.lcs_length(key("a"), key("b")), key("a"), key("b"))
    for r in df.select("a", "b", native.alias("n"), similarity.token_sort_ratio("a", "b").alias("u")).collect():
        block = similarity.LabelBlock([similarity.sort_tokens(r["b"])]).ratio(similarity.sort_tokens(r["a"]))[0]
        assert abs(r["n"] - r["u"]) < 1e-9 and abs(r["n"] - block) < 1e-9


