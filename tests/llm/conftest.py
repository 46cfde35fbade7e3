import pytest

#: Words from which fixtures are made.
WORDS = "the of and thing reed onthe antion shea blewh ting orea esti hand over light stone water green house north seven eight river cloud".split()


def prose(n, seed):
    import random

    r = random.Random(seed)
    return [r.choice(WORDS) + r.choice(["", "", "ly", "er", "ing", "s"]) for _ in range(n)]


def odd_documents():
    """Nulls, empties, repeats, ties, near copies, one very long text."""
    base = prose(200, 1)
    near = [*base]
    near[100] = "changed"
    far = [*base]
    far[10::20] = ["other"] * len(far[10::20])
    long = " ".join(prose(30_000, 2))
    rows = [
        (1, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (2, " ".join(base), "en", "a"), (3, " ".join(near), "en", "b"),
        (4, " ".join(far), "en", "b"), (5, None, None, None), (6, "", "en", "c"), (7, " \t\n \n", None, "c"), (8, "Word", "en", "c"), (9, "two words", "en", None),
        (None, "no id at all here but for words", "en", "a"), (10, long, "en", "d"), (11, long + " tail", "en", "d"), (12, "x " * 60, "xx", "e"),
        (13, " ".join(prose(25, 3)) + " " + " ".join(base[40:80]), "en", "e"), (14, "\x85　ü \U0001f600 ß.\nline two of text here now\nline two of text here now", "de", "f"),
        (15, "A B C " + " ".join(base).upper(), "en", "f"), (16, "12345 6789 !!! ???", "en", "f"), (17, "first line of eight words is this one\n" + " ".join(prose(30, 5)), "en", "f"),
        (18, "first line of eight words is that one\nfirst line of eight words is this\n" + " ".join(prose(30, 6)), "en", "f"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(*r, i, "clash", 0.5) for i, r in enumerate(odd_documents())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, doc int, hub string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session", autouse=True)
def _shared(spark, tmp_path_factory):
    """The tests' own shared folder, where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
