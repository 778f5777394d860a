"""Text functions, predicates and parsers on small literal inputs."""

import pytest
from pyspark.sql import functions as F

from docmosaic.functions import fixed, markup, parse, predicates, text


def one(spark, column_of, *values):
    names = [f"v{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return df.select(column_of(*[F.col(n) for n in names]).alias("out")).first().out


@pytest.mark.parametrize(
    "raw, want",
    [("  A  b\tC\n", "a b c"), ("", ""), ("one", "one"), ("x  y　", "x y"), ("\x0b a \x85 b", "a b"), (" \n ", "")],
)
def test_normalize(spark, raw, want):
    assert one(spark, text.normalize, raw) == want == " ".join(raw.lower().split())


@pytest.mark.parametrize("raw", ["\t x y \n", " x ", "", " ", "a  b"])
def test_strip(spark, raw):
    assert one(spark, text.strip, raw) == raw.strip()


def test_slug(spark):
    assert one(spark, text.slug, "  Match Day / Ops--2 ") == "match_day_ops_2"


@pytest.mark.parametrize(
    "name, want",
    [("CRM to ERP LI", ("CRM", "ERP")), ("CRM TO ERP", ("CRM", "ERP")), ("A to B to C", ("A", "B to C")), ("alone", (None, None))],
)
def test_interface_endpoints(spark, name, want):
    got = [one(spark, lambda c, i=i: text.interface_endpoints(c)[i], name) for i in (0, 1)]
    assert tuple(got) == want


def naive_excerpt(chunk, name, window):
    at = chunk.lower().find(name.lower())
    if at < 0:
        return chunk[:window]
    lo, hi = max(0, at - window // 2), min(len(chunk), at + window // 2)
    while lo > 0 and chunk[lo] != " " and chunk[lo - 1] != " " and " " in chunk[:lo]:
        lo -= 1
    blank = chunk.find(" ", hi - 1)
    if hi < len(chunk) and blank >= 0:
        hi = blank
    return chunk[lo:hi].strip()


@pytest.mark.parametrize("body, name", [
    ("alpha beta gamma delta epsilon zeta eta theta iota kappa", "zeta"),
    ("alpha beta gamma", "alpha"), ("alpha beta gamma", "missing"), ("x" * 50 + " Club " + "y" * 50, "club"), ("", "a"),
])
def test_excerpt(spark, body, name):
    assert one(spark, lambda c, n: text.excerpt(c, n, 20), body, name) == naive_excerpt(body, name, 20)


@pytest.mark.parametrize(
    "value, want",
    [(None, False), ("", False), ("[Error: x]", False), ("any club that plays", True), ("  Not defined in FA Handbook", False)]
    + [(p.title() + " here", False) for p in fixed.NO_DEFINITION],
)
def test_real_definition(spark, value, want):
    assert one(spark, predicates.real_definition, value) is want


@pytest.mark.parametrize(
    "value, want",
    [("", False), ("** **", True), ("**Rule A1**", True), ("*No specific rules", False), ("[Error: x]", False), (" Not documented.", False)],
)
def test_real_governance(spark, value, want):
    # an error marker is no content; stars in front are ignored
    expected = want if value != "** **" else bool(value.strip().lstrip("*").strip())
    assert one(spark, predicates.real_governance, value) is expected


@pytest.mark.parametrize(
    "body, passed, score",
    [
        ("", False, 0.0),
        ("x" * 149, False, 0.4),
        ("x" * 150, True, 0.7),
        ("see Rule E1 " + "x" * 150, True, 1.0),
        ("see Rule B1 " + "x" * 150, True, 0.7),
        ("x" * 298 + " i cannot find " + "x" * 150, True, 0.7),
        ("x" * 280 + " i cannot find " + "x" * 150, False, 0.5),
        ("No formal definition. " + "x" * 150, False, 0.5),
    ],
)
def test_quality_gate(spark, body, passed, score):
    gate = one(spark, predicates.quality_gate, body)
    assert (gate.passed, gate.score) == (passed, score)
    assert gate.reasons or passed


def test_boilerplate_looks_at_the_opening_only(spark):
    assert one(spark, predicates.boilerplate, "It is ABSENT from the text")
    assert not one(spark, predicates.boilerplate, "x" * 400 + " is absent")


@pytest.mark.parametrize("label, want", [("Club Account", "party"), ("Live TV", "channel"), ("Account", "account"), ("Asset", "asset"), ("Zzz", "other")])
def test_bucket(spark, label, want):
    assert one(spark, predicates.bucket, label) == want


@pytest.mark.parametrize("score, found, want", [(0.7, 1, "STRONG"), (0.69, 1, "MODERATE"), (0.55, 1, "MODERATE"), (0.4, 1, "THIN"), (0.39, 1, "ABSENT"), (0.9, 0, "ABSENT")])
def test_coverage_verdict(spark, score, found, want):
    df = spark.createDataFrame([(score, found)], "s double, n int")
    assert df.select(predicates.coverage_verdict(F.col("s"), F.col("n")).alias("v")).first().v == want


@pytest.mark.parametrize("start", [None, "ERzeroToMany", "ERoneToMany", "ERoneToOne", "ERzeroToOne"])
@pytest.mark.parametrize("end", [None, "ERzeroToMany", "ERoneToMany", "ERoneToOne", "ERzeroToOne"])
def test_cardinality(spark, start, end):
    marks = dict(fixed.ARROWS)
    style = ";".join([f"startArrow={start}"] * bool(start) + [f"endArrow={end}"] * bool(end))
    want = f"{marks.get(start, '')}-{marks.get(end, '')}"
    assert one(spark, markup.cardinality, style) == (want if want != "-" else None)


def test_cardinality_phrase(spark):
    phrase = lambda m: one(spark, markup.cardinality_phrase, m)
    assert phrase("1..1-1..1") == "relates to (exactly one to exactly one)"
    assert phrase("0..1-") == "relates to (0..1-)"
    assert phrase(None) == phrase("") == "relates to"


def test_clean_label(spark):
    assert one(spark, markup.clean_label, "<b>A&amp;lt;B</b>&#10; &nbsp;C") == "A<B C"


FULL = "\n".join(f"{label}: value of {label}\nmore" for label, _ in fixed.CONTEXT_FIELDS)


def test_labelled_fields(spark):
    df = spark.createDataFrame([(FULL,), ("FORMAL_DEFINITION: only this",), ("nothing",)], "r string")
    out = df.select(*parse.context_fields(F.col("r"))).collect()
    assert [out[0][name] for _, name in fixed.CONTEXT_FIELDS] == [f"value of {label}\nmore" for label, _ in fixed.CONTEXT_FIELDS]
    assert out[1].formal_definition == "only this" and out[1].domain_context == ""
    assert out[2].formal_definition == ""


def test_term_blocks(spark):
    body = "\n\n TERM: A\nDEFINITION: x\n\n\nCATEGORY: early\n\nTERM:\n\nTERM: B\nTERM: C\nGOVERNANCE: g\n"
    blocks = one(spark, parse.term_blocks, body)
    assert [tuple(b) for b in blocks] == [("A", "x", "", ""), ("C", "", "early", "g")]


@pytest.mark.parametrize("said, want", [
    ('RETRIEVE query: "what is it"', ("RETRIEVE", "what is it", [], [])),
    ("retrieve sections: ['s01','s05'] query: \"q\"", ("RETRIEVE", "q", ["s01", "s05"], [])),
    ("RETRIEVE nothing", ("DONE", "", [], [])),
    ('KEYWORD terms: ["a", "b c"]', ("KEYWORD", "", [], ["a", "b c"])),
    ("KEYWORD terms: [a, b c,]", ("KEYWORD", "", [], ["a", "b c"])),
    ("KEYWORD", ("KEYWORD", "", [], [])),
    (" done now", ("DONE", "", [], [])),
    ("what?", ("DONE", "", [], [])),
])
def test_action(spark, said, want):
    assert tuple(one(spark, parse.action, said)) == want


def test_json_object(spark):
    assert one(spark, parse.json_object, 'so: {"a": {"b": 1}}\nend') == '{"a": {"b": 1}}'
    assert one(spark, parse.json_object, "none") is None


@pytest.mark.parametrize("tier, confidence, want", [("existing", "high", "PENDING"), ("existing", "low", "NEEDS_CLARIFICATION"), ("new_proposed", "low", "PROPOSED_NEW_TAXONOMY"), ("unknown", "high", "NEEDS_CLARIFICATION")])
def test_review_status(spark, tier, confidence, want):
    assert one(spark, predicates.review_status, tier, confidence) == want
