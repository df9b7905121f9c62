"""Precision and recall of the novelty part of the secret scan on planted strings."""

import random
import string

import numpy as np
import pytest

from fieldnote.llm import secret_scan as S

FRAMES = ("the token is kept in {} today", "our secret docs: {}", "see {} for the credential", "authorization: {}")
HARMLESS = """/docs/guides/getting-started-with-oauth2-flows src/main/java/com/acme/app/ net/oauth2/v2/authorize JIRA-2024-00012345
token_refresh_interval_seconds=3600 /usr/local/share/ca-certificates/ kubernetes/ingress-nginx/controller getUserAccessTokenFromRequest
com/fasterxml/jackson/databind MAX_LOGIN_ATTEMPTS_PER_HOUR=25 https_proxy_enabled=true 2024-11-30T19:02:58 INV-2023-000918-REV2
org/springframework/security/oauth2 PasswordResetControllerTest assets/images/hero-banner-1920x1080 refresh_token_expires_in=86400
/home/builder/workspace/payments/ customer-billing-address-line-2 lib/python3/site-packages/requests TICKET-4711-2023-00000042
validateSessionCookieBeforeLogin cache_invalidation_delay_ms=250 docker/compose/override/example scripts/deploy/rollback-last-release
+49-30-1234567-890 ORDER-00000123-2024-EU""".split()
ALPHABETS = ("0123456789ABCDEF", string.ascii_uppercase + "234567", string.ascii_lowercase + string.digits, string.ascii_letters + string.digits + "+/",
             string.ascii_letters + string.digits + "_-", string.ascii_lowercase, string.ascii_letters)


def _novel(text, names):
    return [text[a:b] for a, k, b in S.novel_spans(text, [], names=names) if k == 3]


@pytest.fixture(scope="module")
def corpus(spark):
    """Pairs of a small corpus in which a third of the words are keys: they must not teach what a name is."""
    rng = random.Random(8)
    words = "the river and the window were open while market people looked for stone houses along the old road of the town".split()
    texts = [" ".join(rng.choices(words, k=40) + ["".join(rng.choices(ALPHABETS[3], k=32)) for _ in range(20)]) for _ in range(30)]
    return S.letter_pairs(spark.createDataFrame([(t,) for t in [*texts, None, ""]], "text string").repartition(3))


def test_harmless_strings_are_no_secrets(corpus):
    texts = [f.format(w) for f in FRAMES for w in HARMLESS]
    assert sum(bool(_novel(t, S.Names(corpus))) for t in texts) <= 0.02 * len(texts)
    assert sum(bool(_novel(t, None)) for t in texts) <= 0.05 * len(texts)


@pytest.mark.parametrize("letters", ALPHABETS)
def test_random_keys_are_found(corpus, letters):
    rng, names = random.Random(3), S.Names(corpus)
    for n in (16, 20, 32, 64):
        keys = ["".join(rng.choices(letters, k=n)) for _ in range(100)]
        assert sum(_novel(FRAMES[i % 4].format(w), names) == [w] for i, w in enumerate(keys)) >= 95


def test_pairs_are_counted_over_all_documents(spark):
    got = S.letter_pairs(spark.createDataFrame([("abba Ab",), ("a b " + "ab" * 8,), (None,)], "text string"))
    want = np.zeros((26, 26), int)
    want[0, 1], want[1, 1], want[1, 0] = 2, 1, 1
    assert (got == want).all()
    assert S.letter_pairs(spark.createDataFrame([], "text string")).sum() == 0


def test_a_text_of_several_megabytes(spark):
    key = "Zq7Rk2Vx9LmT4bW8nYc5"
    text = "plain words of a long text " * 200_000 + f"the access key is {key}"
    (row,) = S.scan_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["spans"] == f"novel:{text.index(key)}:{len(text)}"
