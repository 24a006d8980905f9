import numpy as np
import pytest

from tomewise.llm import pii


@pytest.mark.parametrize(
    "text, value",
    [('les token = "24be64439e3e49cf"### so', "24be64439e3e49cf"), ("is: PASSWORD : hunter2hunter now", "hunter2hunter"), ('{"api_key": "ab12cd34ef56"}', "ab12cd34ef56"), ("secret=" + "x9" * 300, "x9" * 300)],
)
def test_a_candidate_covers_the_value(text, value):
    a = text.index(value)
    assert pii.credentials(text)[0][0] == a
    assert any(c <= a and a + len(value) <= d for c, d in pii.candidates(text) if not text[c:d].startswith("is:"))
    key = next(k for k in ("token", "PASSWORD", "api_key", "secret") if k in text)
    assert any(c == text.index(key) and a + len(value) <= d for c, d in pii.candidates(text))


def test_secrets_with_spaces_are_found_and_redacted(spark):
    r = np.random.default_rng(3)
    rows, secrets = [], {}
    for i in range(800):
        secrets[i] = "".join(r.choice(list("0123456789abcdef"), 40))
        rows.append((i, ["call +1 (555) 555-2485 now", f'les token = "{secrets[i]}" erble', "mail a.b@mail.example.com ok", "made in chapter12345: of it"][i % 4]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {x.doc_id: x.text for x in pii.redact(df, pii.fit(df)).collect()}
    left = [i for i in range(1, 800, 4) if secrets[i] in clean[i]]
    assert len(left) <= 4 and clean[3] == rows[3][1]
