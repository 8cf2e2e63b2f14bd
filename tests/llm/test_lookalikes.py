import unicodedata

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from folioworks.llm.lookalikes import class_members, look_classes, look_pairs, one_form, with_one_form

ACCENTED = "aeoxzACEsdụ̧́̈̂éẹ한한ñ \nйёи"


def form(*texts):
    return one_form(pa.array(list(texts), pa.string())).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ACCENTED, max_size=12), st.text(alphabet=ACCENTED, max_size=5))
def test_composition_is_that_of_the_standard(x, y):
    got = form(x, unicodedata.normalize("NFD", x), unicodedata.normalize("NFC", x), y)
    assert len(set(got[:3])) == 1 and unicodedata.normalize("NFC", got[0]) == got[0]
    assert got[3] == form(y)[0]  # rows don't touch


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), max_size=6))
def test_any_text(texts):
    got = one_form(pa.array(texts, pa.string()))
    again = one_form(got).to_pylist()
    assert got.to_pylist() == again  # applying it twice changes nothing
    assert [x is None for x in texts] == [x is None for x in again]
    assert [form(x)[0] for x in texts] == again  # a batch is its rows


def test_what_looks_the_same():
    for a, b in [
        ("ＡＢＣ １２，", "ABC 12,"), ("\u041d\u043e\u0442\u0435", "Ho\u0442e"), ("Αθ", "Aθ"), ("a\u00a0b\u2009c", "a b c"), ("so­ft​​", "soft"), ("\u212aelvin", "Kelvin"), ("ﬁn", "fin"), ("e\u0301", "\u00e9"),
        ("‎x⁠﻿", "x"), ("ѕіх", "six"), ("µ", "μ"), ("\u03bd", "v"), ("\u0585", "o"), ("\u2c9f", "o"), ("\u13aa", "A"), ("\ua4ee", "A"), ("\U0001d400\U0001d41b", "Ab"), ("\u2160X", "IX"),
    ]:
        x, y = form(a, b)
        assert x == y, (a, b, x, y)


def test_what_does_not():
    pairs = [("a", "A"), ("e", "é"), ("2", "²"), ("a b", "a  b"), ("a\nb", "a b"), ("1", "l"), ("“x”", '"x"'), ("й", "и"), ("ı", "i"), ("г", "r"), ("x²", "x2"), ("3 × 4", "3 x 4"), ("0", "O"), ("ª", "a")]
    for a, b in pairs:
        x, y = form(a, b)
        assert x != y, (a, b)


def test_confusables_data_in_all_its_files(tmp_path):
    from folioworks.llm.confusables import default_path, letter_shapes, skeletons

    pairs = letter_shapes()
    data = skeletons(default_path())
    assert len(pairs) > 500 and all(data.get(a, chr(a)) == data.get(b, chr(b)) for a, b in pairs)
    plain = tmp_path / "confusables.txt"
    plain.write_text("# c\n" + "".join(f"{c:04X} ;\t{' '.join(f'{ord(x):04X}' for x in s)} ;\tMA # x\n" for c, s in data.items()), encoding="utf-8")
    assert letter_shapes(str(plain)) == pairs


def test_a_class_of_many_copies_and_texts(spark):
    """Copies of one text make no pairs among themselves; a class of many texts is spread over salts."""
    from pyspark.sql import functions as F

    rows = [(i, "c", "t0") for i in range(300)] + [(1000 + i, "c", f"t{i + 1}") for i in range(40)] + [(5000, "d", "t0x")]
    df = spark.createDataFrame(rows, "doc_id long, class_id string, text_id string").select("doc_id", F.col("class_id"), F.col("text_id"))
    got = [tuple(r) for r in look_pairs(df, salt_texts=7).collect()]
    assert len(got) == len(set(got)) == 300 * 40 + 40 * 39 // 2 and all(a < b for a, b in got)


def test_russian_stays_russian():
    text = "Он сказал: а вот и море"
    assert form(text) == [text] and form(text.replace("о", "o").replace("а", "a").replace("с", "c")) == [text]


def test_rows(spark):
    ddl = "doc_id long, text string, form string, class_id string"
    rows = [(1, "Ｈi", "", ""), (2, "Hi", "", ""), (3, "Hi", "", ""), (4, None, "", ""), (5, "", "", ""), (6, "​", "", ""), (7, "hi", "", ""), (2, "Hi", "", ""), (8, "x" * 1_000_000 + "\u00e9", "", ""), (9, "x" * 1_000_000 + "e\u0301", "", "")]
    df = spark.createDataFrame(rows, ddl)
    classes = look_classes(df)
    assert sorted(tuple(r) for r in look_pairs(classes).collect()) == [(1, 2), (1, 3), (5, 6), (8, 9)]
    assert classes.select("doc_id").distinct().count() == 8
    members = sorted({(r.doc_id, r.class_of, r.text_of) for r in class_members(classes).collect()})
    assert members == [(1, 1, 1), (2, 1, 2), (3, 1, 2), (5, 5, 5), (6, 5, 6), (7, 7, 7), (8, 8, 8), (9, 8, 9)]
    out = with_one_form(df.where("doc_id < 7"), "text", "form", max_chars=1)
    assert out.columns == ["doc_id", "text", "class_id", "form"]
    assert {r.doc_id: r.form for r in out.collect()} == {1: "Hi", 2: "Hi", 3: "Hi", 4: None, 5: "", 6: ""}
    assert look_pairs(look_classes(df.limit(0))).count() == 0
