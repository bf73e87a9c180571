import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators.fields import FieldGrammar, split_field

TERMS = ["Đất đai", "Thuế, phí và lệ phí", "Báo chí; xuất bản", "Điện/nước", "Lao động - Tiền lương", "Y tế"]


def values(text, terms=None):
    return [v for _, v, _, _ in FieldGrammar(terms).parse(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Đất đai; Y tế", ["Đất đai", "Y tế"]),
        ("Báo chí; xuất bản", ["Báo chí; xuất bản"]),
        ("Thuế, phí và lệ phí, Điện/nước / Y tế", ["Thuế, phí và lệ phí", "Điện/nước", "Y tế"]),
        ('"Thuế, phí và lệ phí", Y tế', ["Thuế, phí và lệ phí", "Y tế"]),
        ('["Y tế", "Báo chí; xuất bản"]', ["Y tế", "Báo chí; xuất bản"]),
        ("(1) Y tế (2) Đất đai", ["Y tế", "Đất đai"]),
        ("1. Y tế\r\n2. Lao động - Tiền lương", ["Y tế", "Lao động - Tiền lương"]),
        ("- Y tế\n- Đất đai", ["Y tế", "Đất đai"]),
        ("«Y tế» «Đất đai» - «Điện/nước»", ["Y tế", "Đất đai", "Điện/nước"]),
        ("Y tế; ;Đất đai;", ["Y tế", "Đất đai"]),
        (" ; ", []),
        ("", []),
        (None, []),
    ],
)
def test_sectors(text, want):
    assert values(text, TERMS) == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("A B (Phó Giám đốc, phụ trách); C D", ["A B (Phó Giám đốc, phụ trách)", "C D"]),
        ('Vi Mộc "Út" Diệp | TS. X Y', ['Vi Mộc "Út" Diệp', "TS. X Y"]),
        (r'["Vi \"Út\" A", "B"]', ['Vi "Út" A', "B"]),
        ("A B, C D và E F", ["A B", "C D", "E F"]),
        ("A B & C D", ["A B", "C D"]),
        ('"A ""B"" C"; D', ['A "B" C', "D"]),
        ("1) A 2) TM. B", ["A", "TM. B"]),
    ],
)
def test_signers(text, want):
    assert values(text) == want


def test_malformed_quotes_fall_back_and_are_flagged():
    got = FieldGrammar(None).parse('"A B; C')
    assert [v for _, v, _, _ in got] == ['"A B', "C"]
    assert got[0][3] == "unclosed"
    assert FieldGrammar(TERMS).parse("Không có; Y tế")[0][3] == "unknown"
    assert values('["A", 1]') and values('["A"; "B"]')


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_any_text_ends(text):
    got = FieldGrammar(TERMS).parse(text)
    assert [p for p, *_ in got] == list(range(1, len(got) + 1))
    assert all(v for _, v, _, _ in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(TERMS), min_size=1, max_size=6), st.sampled_from(["; ", ", ", " | ", "\n", " • ", "; ;"]))
def test_round_trip(names, joint):
    assert values(joint.join(names), TERMS) == names
    assert values(joint.join(f'"{n}"' for n in names), TERMS) == names


def test_rows(spark):
    df = spark.createDataFrame([(1, "A; B", "x"), (2, None, "y"), (3, "  ", None), (1, "A; B", "x")], "k long, v string, pos string")
    got = sorted(tuple(r) for r in split_field(df.select("k", "v"), ["k"], "v").collect())
    assert got == [(1, 1, "A", False, None), (1, 1, "A", False, None), (1, 2, "B", False, None), (1, 2, "B", False, None)]
    assert split_field(df.where("k > 9"), ["k"], "v").count() == 0
