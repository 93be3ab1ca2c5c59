import random
import re

from spokenframe.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base(s):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(s)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(s) if all(int(x) < 256 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(s) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(s) if 9 <= len(digits(m)) <= 15]


def test_base_rules_like_the_patterns():
    r = random.Random(2)
    parts = ["a@b.c", "a", ".", "@", "1", "12", "_", "-", " ", "1.2", "255", "256", "+", "(", ")", "4111111111111111", "555", "é", "+1 (269) 555-3296 "]
    for _ in range(4000):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(s) == base(s), s
        kept = [x[:3] for x in pii.find_spans(s) if x[4]]
        assert sorted(kept) == sorted(base(s))


def test_checksums():
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB82 WEST 1234 5698 7654 33")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_the_method_adds_spans_and_masks():
    s = "Phone +1 (269) 555-3296 4111111111111111 and IBAN GB82 WEST 1234 5698 7654 32, SSN 123-45-6789, token = abcdef123456"
    kinds = {k for k, *_ in pii.find_spans(s)}
    assert kinds == {"phone", "card", "iban", "ssn", "secret"}
    masked = pii.mask(s, pii.find_spans(s))
    assert not re.search("[0-9]{4}", masked) and "<IBAN>" in masked and "<SECRET>" in masked
    assert pii.mask("plain words", []) == "plain words"
    assert [x for x in pii.find_spans("order 123-45-6789")] == []


def test_long_secrets_go_to_their_end():
    body = "aB3" * 1667
    for head, secret in (("token=", body), ("api_key: ", body), ("", "sk-" + body), ("", "xoxb-" + body), ("", "xoxb-" + "12-ab" * 1000), ("", "ghp_" + body)):
        s = f"Log in by {head}{secret} or not"
        assert [x[:3] for x in pii.find_spans(s)] == [("secret", 10 + len(head), 10 + len(head) + len(secret))]
        assert pii.mask(s, pii.find_spans(s)) == f"Log in by {head}<SECRET> or not"
    for s in ("token=" * 50_000, "token=a " * 50_000, "sk-" * 100_000, "xoxb-" * 60_000, "ghp_" * 75_000):
        pii.find_spans(s)


def test_linear_on_long_texts():
    for s in ("1" * 300_000, "a" * 300_000 + "@", "+1" + "(" * 300_000, "1." * 100_000, "a@" * 100_000):
        pii.find_spans(s)


def test_odd_rows(odd_docs, no_docs):
    got = pii.pii_spans(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert {x.doc_id for x in got if x.spans} == {1, 5, 7}
    out = pii.masked(odd_docs)
    assert out.columns == odd_docs.columns
    texts = {x.doc_id: x.text for x in out.collect()}
    assert texts[2] is None and texts[3] == "" and "<EMAIL>" in texts[7]
    assert pii.pii_spans(no_docs).count() == 0 and pii.masked(no_docs).count() == 0


def test_spelt_addresses_go_to_their_end():
    labels = ".".join("abcdefghij")
    for local in ("me", "m" * 500):
        for domain in (f"{labels}.com", "x [dot] y(dot)z [dot] org", "a" * 300 + ".com"):
            s = f"Write {local} [at] {domain}. Then wait"
            assert pii.mask(s, pii.find_spans(s)) == "Write <EMAIL>. Then wait"
    for s in ("a [at] " * 50_000, "a" * 300_000 + " [at", "a [at] b" + ".c" * 100_000, "a [at] b" + " [dot] c" * 50_000 + "!"):
        pii.find_spans(s)
