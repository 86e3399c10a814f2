from hypothesis import given, settings
from hypothesis import strategies as st

from stratalith.llm.splitting import Limits, oversized_pieces, size_of, split

LIMITS = Limits("t", 40, 60, 6)


def _check(text, limits):
    pieces = split(text, limits)
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for i, p in enumerate(pieces):
        assert p.start <= p.fresh <= p.end
        assert size_of(text[p.start : p.end]) <= limits.maximum
        if i:
            assert p.fresh == pieces[i - 1].end and p.start >= pieces[i - 1].start
    return pieces


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["word", "a", "longerword ", ". ", "\n", "\n\n", ", ", "中文。", "😀", "\r\n", "é", " ", "x" * 50]), max_size=200))
def test_pieces_cover_and_keep_the_limit(parts):
    _check("".join(parts), LIMITS)


def test_cuts_at_paragraphs_and_near_the_target():
    paragraph = "Some words make up a paragraph here. " * 3
    text = "\n\n".join([paragraph.strip()] * 40)
    pieces = _check(text, Limits("p", 100, 150, 10))
    assert sum(p.boundary == 5 for p in pieces[:-1]) >= len(pieces) * 0.6
    assert all(50 <= p.tokens <= 150 for p in pieces)


def test_overlap_is_shared():
    text = "alpha beta gamma delta. " * 300
    pieces = split(text, Limits("o", 100, 150, 20))
    for p in pieces[1:]:
        assert 14 <= size_of(text[p.start : p.fresh]) <= 26


def test_no_boundaries():
    for text in ("x" * 5000, "́" * 3000, "😀" * 2000, "a " * 3000, " " * 4000 + "z"):
        _check(text, LIMITS)


def test_rows(spark):
    rows = [("a", "word " * 200, 1, "keep"), ("a", "word " * 200, 2, "keep"), ("b", None, 1, ""), ("c", "", 1, ""), (None, "word " * 200, 1, ""), ("d", "short", 1, "")]
    df = spark.createDataFrame(rows, "id string, text string, indexed_at int, tokens string")
    got = oversized_pieces(df, [LIMITS, Limits("wide", 500, 900, 5)]).toPandas()
    assert set(zip(got.profile_name, got.node_id)) == {("t", "a")}
    assert got.sort_values("piece_no").text.iloc[0].startswith("word")
    assert oversized_pieces(df.where("false"), [LIMITS]).count() == 0


def test_the_latest_delivery_decides_even_if_it_is_short(spark):
    long = "word " * 200
    rows = [("late-short", long, 1), ("late-short", "short", 2), ("late-null", long, 1), ("late-null", None, 2), ("late-long", "short", 1), ("late-long", long, 2)]
    got = oversized_pieces(spark.createDataFrame(rows, "id string, text string, indexed_at int"), [LIMITS], with_text=False)
    assert {r.node_id for r in got.select("node_id").distinct().collect()} == {"late-long"}


def test_a_character_keeps_its_marks_however_many():
    text = ("e" + "\u0301" * 60) * 100
    assert all(not p.start or text[p.start] == "e" for p in _check(text, Limits("m", 40, 60, 0)))


def test_exact_limit_is_not_split():
    assert len(split("w " * 60, Limits("e", 40, 60, 5))) == 1 and len(split("w " * 61, Limits("e", 40, 60, 5))) > 1
