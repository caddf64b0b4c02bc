import json
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from rankloom.operators import packed_fields
from rankloom.operators.packed_fields import author_values, issn_values, split_packed, tokenize


def test_author_layouts():
    two = ["Family, Given", "Other, Name B."]
    assert author_values("Family, Given; Other, Name B.;") == two
    assert author_values('"Family, Given","Other, Name B."') == two
    assert author_values('["Family, Given", "Other, Name B."]') == two
    assert author_values("['Family, Given', \"O'Ther, Name B.\"]") == ["Family, Given", "O'Ther, Name B."]
    assert author_values("Family, Given | Other, Name B.\nGiven Third") == [*two, "Given Third"]
    assert author_values("Ann Lee, Bo Roe und Pavel Marsh") == ["Ann Lee", "Bo Roe", "Pavel Marsh"]
    assert author_values("Lee A, van der Roe BC et Marsh E") == ["Lee A", "van der Roe BC", "Marsh E"]
    assert author_values("Lee, A., O'Roe, B. C., & de la Marsh, E.") == ["Lee, A.", "O'Roe, B. C.", "de la Marsh, E."]
    assert author_values("Lee E und Roe C") == ["Lee E", "Roe C"]
    assert author_values("Lee, A.; Working Group on Lists and Bias Quality") == ["Lee, A.", "Working Group on Lists and Bias Quality"]
    assert author_values("Ann Lee; Bo Roe; et al.") == ["Ann Lee", "Bo Roe"]
    assert author_values("Lee, Ann") == ["Lee, Ann"]


def test_escapes_and_quotes():
    assert author_values('["Tom\\u00e1s Lee", "Bo \\"B\\" Roe"]') == ["Tomás Lee", 'Bo "B" Roe']
    assert tokenize('"a;b";"c""d"')[0][0] == "a;b" and tokenize('"a;b";"c""d"')[1][0] == 'c"d'
    assert [x for x, _, _ in tokenize('"open end')] == ["open end"]


def test_issns():
    assert issn_values("1234-5678; eISSN: 8765432x") == ["1234-5678", "8765-432X"]
    assert issn_values("123456788765432X11112222") == ["1234-5678", "8765-432X", "1111-2222"]
    assert issn_values('["12345678", "1234–5678"]') == ["1234-5678", "1234-5678"]
    assert issn_values("none") == [] and issn_values("") == []


@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc", "Zl", "Zp", "Zs")), min_size=1, max_size=8).filter(lambda x: x.strip(" .,;") and x.lower() not in ("al", "others", "al.", "et al", "et al.")), min_size=2, max_size=5))
def test_json_lists_come_back(values):
    assert author_values(json.dumps(values)) == [v for v in values]


def test_operator(spark):
    rows = [(1, "A B; C D", 9), (2, None, 9), (3, "", 9), (4, "[]", 9), (5, "Lee, Ann", 9), (6, "A B; A B", 9), (7, "; ".join(["Ann Lee"] * 5000), 9)]
    df = spark.createDataFrame(rows, "row_id long, authors string, pos int")
    out = {(r.row_id, r.pos): r.item for r in split_packed(df, "row_id", "authors", "authors", min_values=2).collect()}
    assert out[1, 1] == "A B" and out[1, 2] == "C D" and out[6, 2] == "A B" and out[7, 5000] == "Ann Lee" and len(out) == 5004
    assert split_packed(df.limit(0), "row_id", "authors", "authors").count() == 0


def test_simple_lists_need_no_walk(monkeypatch):
    rng = random.Random(2)
    bits = ["A", "B.", "de", "Lee", '"', "'", "[", "]", ",", ";", " ", " and ", " et", "y ", " & ", "\n", "\r", "Jr", "et al.", "O'Neil", "\\", "É"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(5_000)] + ["[]", '["", "Lee, A."]', "['Lee, A.', 'Roe']", '"Lee, A.";"Roe"', '"Lee""s"', " and Lee"]
    got = [author_values(x) for x in texts]
    with monkeypatch.context() as m:
        m.setattr(packed_fields, "_STOP", None)  # a walk would fail
        assert author_values("Lee, A., Roe, B. and O'Neil, C.") == ["Lee, A.", "Roe, B.", "O'Neil, C."]
        assert author_values('["Lee, A.", "Roe, B."]') == ["Lee, A.", "Roe, B."]
    monkeypatch.setattr(packed_fields, "_NESTING", re.compile(""))
    monkeypatch.setattr(packed_fields, "_LISTED", ())
    assert got == [author_values(x) for x in texts]
