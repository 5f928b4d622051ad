import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept string, "
          "component_id string, n_words string, host string, language string, toxic string")
EXTRA = (0.5, "k", "c", "w", "h", "l", "t")
ENGLISH = "the cat sat on the mat and then it went to the market with all of the other cats of the town because it was hungry "
FRENCH = "le chat est dans la maison et il va au marché avec tous les autres chats de la ville parce que tout le monde a faim "


def rows(*documents):
    return [(*d, *EXTRA) for d in documents]


@pytest.fixture(scope="session")
def odd(spark):
    """NULLs in any column, empty and very long texts, repeated rows, and columns whose names clash."""
    long = "x" * 120_000 + " " + ENGLISH * 400
    return spark.createDataFrame(rows(
        (1, ENGLISH * 4, "en", "a", 1), (1, ENGLISH * 4, "en", "a", 1), (2, ENGLISH * 4 + "end", "en", "a", None),
        (3, None, "en", "a", 0), (4, "", None, None, 0), (5, "  \n\t ", "fr", None, 5), (6, long, "en", "b", 9),
        (7, FRENCH * 5, "fr", "b", 2), (8, "123 456 !!", None, "b", 3), (None, FRENCH * 5, "fr", None, 2),
        (9, "one", "en", "c", 3), (10, "日本 é é́ \x00  ß İ don't", None, "c", 3)), SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
