import unicodedata

from pyspark.sql import functions as F

from lexatlas.functions import scoring
from lexatlas.functions import text as tx
from lexatlas.functions import unicode as uc


def values(spark, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, "a string, b string").select(*columns).collect()]


def test_unicode_matches_python(spark):
    samples = ["Straße İ ΑΣ", "é Điều", "ﬁ ½ Ⅷ", "ŉ ǰ ΐ ẞ", "plain", "Tiếng Việt", "K ẛ̣", "Ꭰꭰ ς"]
    rows = values(
        spark, [(s, s) for s in samples], "a", uc.casefold(F.col("a")), uc.normalized(F.col("a"), "NFC"), uc.normalized(F.col("a"), "NFKC", True)
    )
    for text, folded, nfc, nfkc in rows:
        assert folded == text.casefold()
        assert nfc == unicodedata.normalize("NFC", text)
        assert nfkc == unicodedata.normalize("NFKC", text).casefold()


def test_identifiers_and_accents(spark):
    rows = values(spark, [("Luật Đất đai 2013!", "Ñandú")], uc.safe_id(F.col("a")), uc.document_slug(F.col("a")), uc.fold_accents(F.col("a")), uc.fold_accents(F.col("b")))
    assert rows == [("luat_d_vnat_d_vnai_2013", "luat_dat_dai_2013", "luat dat dai 2013!", "nandu")]


def test_tokens_lines_ngrams(spark):
    text = "a b\tc d\nĐiều_1, x"
    rows = values(
        spark, [(text, "p\n\n \nq\n")], tx.token_count(F.col("a")), tx.word_tokens(F.col("a")), tx.lines(F.col("b")), tx.paragraphs(F.col("b")),
        tx.ngrams_1_to_3(F.split(F.lit("x y z"), " ")), tx.ngrams_1_to_3(F.array().cast("array<string>")),
    )
    assert rows == [(6, ["a", "b", "c", "d", "điều_1", "x"], ["p", "", " ", "q"], ["p", "q"], ["x", "y", "z", "x y", "y z", "x y z"], [])]


def test_overlap_scores(spark):
    rows = values(spark, [("a b", "a b"), ("a b c", "a c"), ("", ""), ("é x", "x")], scoring.meteor(F.col("a"), F.col("b")), scoring.rouge_l(F.col("a"), F.col("b")), scoring.rouge_l_unicode(F.col("a"), F.col("b")))
    assert rows[0] == (0.9375, 1.0, 1.0)
    assert abs(rows[1][1] - 0.8) < 1e-12
    assert rows[2] == (0.0, 0.0, 1.0)


def lcs_table(a, b):
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
    return grid[-1][-1]


def test_lcs_against_table():
    import random

    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        assert scoring.lcs_length(a, b) == lcs_table(a, b)


def test_citation_tokens(spark):
    rows = values(spark, [("Theo Điều 5 và 12/2013/qh13 ABC", "")], scoring.citation_tokens(F.col("a")))
    assert rows == [(["theo", "Điều 5", "và", "12/2013/qh13", "abc"],)]
