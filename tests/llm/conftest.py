import re

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def odd(spark):
    """Awkward documents: nulls, empties, repeats, long texts, no ids, columns with clashing names."""
    long = " ".join(WORDS[i * i % 20] + str(i) for i in range(4000))
    rows = [
        (0, "Alpha beta gamma delta epsilon zeta"), (1, "alpha  beta\tgamma delta epsilon zeta"), (2, None), (3, ""), (4, " \n "), (5, "x"), (6, "x"), (7, long), (8, long + " tail"), (9, long), (None, "x"), (None, None), (10, "ünï \U0001f642 ça"), (5, "x"), (11, "\x00\x01 a"),
    ]
    cols = "doc_id long, text string, n long, sig long, kept boolean, digest string, row long, locator long, lang string"
    return spark.createDataFrame([(a, b, 1, 2, True, "d", 3, 4, "en" if a and a % 2 else None) for a, b in rows], cols)


@pytest.fixture(scope="session")
def nothing(spark, odd):
    return odd.where("false")


def words_of(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower)
