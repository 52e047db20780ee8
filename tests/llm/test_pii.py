import datetime as dt
import random

from hypothesis import given, settings, strategies as st

from sparrowhawk.llm import pii_pseudonyms as I

from .helpers import EDGE, documents

N, BACK = I.Pseudonyms(b"k"), I.Pseudonyms(b"k", back=True)
TEXT = (
    "Mail jo.doe7@mail3.example.com, call +1 (377) 555-0271 or 415-555-2671, card 4111 1111 1111 1111 or 5500005555555559, "
    "ip 10.20.30.40, ssn 123-45-6789, born 1987-02-28, 31.12.1999 and 07/04/1976, iban DE89 3704 0044 0532 0130 00, account 1234567890123456."
)
KINDS = ["email", "phone", "phone", "card", "card", "ipv4", "ssn", "date", "date", "date", "iban", "number"]


def test_every_kind_is_found_changed_and_valid():
    new, spans = I.pseudonymise(TEXT, N)
    assert [k for *_, k, _ in spans] == KINDS
    assert all(TEXT[s:e] not in new for s, e, *_ in spans)
    again, spans2 = I.pseudonymise(new, BACK)
    assert again == TEXT and [k for *_, k, _ in spans2] == KINDS
    for s, e, kind, v in spans:
        assert len(v) == e - s or kind == "ipv4"
        assert "".join("0" if c.isdigit() else c for c in v) == "".join("0" if c.isdigit() else c for c in TEXT[s:e]) or kind in ("ipv4", "email", "iban")


def test_equal_values_stay_linked_and_keys_differ(spark):
    rows = [(1, f"x {TEXT}"), (2, TEXT[5:]), *((i + 10, t) for i, (_, t) in enumerate(EDGE))]
    got = {r["doc_id"]: r for r in I.mask(documents(spark, rows), b"k").collect()}
    assert got[1]["text"][2:] == got[2]["text"].rjust(len(got[1]["text"]) - 2, "?").replace("?" * 5, "Mail ") or got[1]["text"][7:] == got[2]["text"]
    assert got[1]["n_values"] == len(KINDS)
    for i, (_, t) in enumerate(EDGE):
        assert got[i + 10]["text"] == t and got[i + 10]["n_values"] == 0 and got[i + 10]["spans"] == ""
    assert I.pseudonymise(TEXT, I.Pseudonyms(b"other"))[0] != got[1]["text"][2:]
    assert I.mask(documents(spark, [(1, "x")]).where("false"), b"k").count() == 0


def test_clean_numbers_stay():
    for text in ("version 1.2.3", "in 2024 there were 1500 of 12 345", "pi is 3.14159265358979", "999.999.1.1", "31.02.2020", "2020-13-01", "000-12-3456", "room 12-34", "a@b", "10 20 30 40 50 60 70"):
        assert I.pseudonymise(text, N)[0] == text


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 10**17), st.data())
def test_permutation(size, data):
    x = data.draw(st.integers(0, size - 1))
    y = N.feistel.permute(x, size, b"t")
    assert 0 <= y < size and N.feistel.permute(y, size, b"t", back=True) == x


def test_small_domains_are_permuted():
    for size in (2, 10, 26, 73049 // 100):
        assert sorted(N.feistel.permute(x, size, b"t") for x in range(size)) == list(range(size))


def test_dates_are_dates():
    rng = random.Random(2)
    seen = set()
    for _ in range(300):
        d = dt.date.fromordinal(I.FIRST_DAY + rng.randrange(I.DAYS))
        new = dt.date.fromisoformat(N.of("date", d.isoformat()))
        assert N.of("date", f"{d.day:02d}.{d.month:02d}.{d.year}") == f"{new.day:02d}.{new.month:02d}.{new.year}"
        seen.add((d, new))
    assert len({a for a, _ in seen}) == len({b for _, b in seen})


def test_every_layout_of_a_date_is_kept_restored_and_linked():
    rng = random.Random(3)
    for _ in range(200):
        d = dt.date.fromordinal(I.FIRST_DAY + rng.randrange(I.DAYS))
        texts = {d.isoformat()}
        for day in {str(d.day), f"{d.day:02d}"}:
            for month in {str(d.month), f"{d.month:02d}"}:
                texts |= {f"{day}.{month}.{d.year}", f"{month}/{day}/{d.year}"}
        made = {t: N.of("date", t) for t in texts}
        assert len(set(made.values())) == len(texts) and all(len(k) == len(v) for k, v in made.items())
        assert all(BACK.of("date", v) == k for k, v in made.items())
        day = dt.date.fromisoformat(made[d.isoformat()])
        for t, v in made.items():
            parts = [int(x) for x in v.replace("/", ".").replace("-", ".").split(".")]
            assert sorted(parts) == sorted([day.year, day.month, day.day])


def test_every_layout_of_a_phone_is_kept_restored_and_linked():
    digits = lambda t: "".join(c for c in t if c.isdigit())
    for own in ("3775550271", "4155552671", "1155550271"):
        texts = [f"+1{own}", f"+1 ({own[:3]}) {own[3:6]}-{own[6:]}", f"+1 {own[:3]} {own[3:6]} {own[6:]}", f"({own[:3]}) {own[3:6]}-{own[6:]}", f"{own[:3]}-{own[3:6]}-{own[6:]}"]
        made = [N.of("phone", t) for t in texts]
        assert len({digits(v)[-10:] for v in made}) == 1 and all(digits(v)[:-10] in ("", "1") for v in made)
        assert [BACK.of("phone", v) for v in made] == texts
        assert I.plausible("1", digits(made[0])[-10:]) == I.plausible("1", own) and digits(made[0])[-10:] != own
    a, b = N.of("phone", "+49 30 1234567"), N.of("phone", "+49301234567")
    assert digits(a) == digits(b) and a.startswith("+49 ") and BACK.of("phone", a) == "+49 30 1234567"
    assert N.of("phone", "+420 601 123 456").startswith("+420 ")


def test_there_is_no_key_by_default(spark):
    import pytest

    with pytest.raises(TypeError):
        I.mask(documents(spark, [(1, "x")]))
    with pytest.raises(ValueError):
        I.mask(documents(spark, [(1, "x")]), b"")


# -- an own finder: no patterns, every stretch of a kind's characters is tried ------------------------

DIGITS, LETTERS = set("0123456789"), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM = DIGITS | LETTERS


def number_parts(t, signs):
    """Runs of digits and the signs between them, or None."""
    runs, marks = [""], []
    for c in t:
        if c in DIGITS:
            runs[-1] += c
        elif c in signs and runs[-1]:
            marks.append(c)
            runs.append("")
        else:
            return None
    return (runs, marks) if runs[-1] else None


def luhn(t):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(t))) % 10 == 0


def is_email(t):
    name, at, host = t.partition("@")
    labels = host.split(".")
    return at and name and set(name) <= ALNUM | set("._%+-") and len(labels) > 1 and all(x and set(x) <= ALNUM | {"-"} for x in labels) and len(labels[-1]) > 1 and set(labels[-1]) <= LETTERS


def is_ipv4(t):
    p = number_parts(t, ".")
    return p and len(p[0]) == 4 and all(len(x) < 4 and int(x) < 256 for x in p[0])


def is_card(t):
    p = number_parts(t, " -")
    if not p or not luhn("".join(p[0])):
        return False
    sizes = [len(x) for x in p[0]]
    return len(sizes) == 1 and 13 <= sizes[0] <= 19 or sizes == [4] * 4 or sizes[:4] == [4] * 4 and len(sizes) == 5 and sizes[4] < 4 or sizes == [4, 6, 5]


def is_ssn(t):
    p = number_parts(t, "-")
    return p and [len(x) for x in p[0]] == [3, 2, 4] and p[0][0] not in ("000", "666") and p[0][0] < "900" and p[0][1] != "00" and p[0][2] != "0000"


def is_date(t):
    p = number_parts(t, "-./")
    if not p or len(p[0]) != 3 or p[1][0] != p[1][1]:
        return False
    a, b, c = p[0]
    y, m, d, ok = {"-": (a, b, c, [len(a), len(b), len(c)] == [4, 2, 2]), ".": (c, b, a, len(c) == 4 and len(a) < 3 and len(b) < 3), "/": (c, a, b, len(c) == 4 and len(a) < 3 and len(b) < 3)}[p[1][0]]
    try:
        return ok and 1900 <= dt.date(int(y), int(m), int(d)).year < 2100
    except ValueError:
        return False


def found_by_trying(text, kind):
    chars, ok, before, after = {
        "email": (ALNUM | set("._%+-@"), is_email, ALNUM | set("._%+-"), ALNUM | {"-"}),
        "ipv4": (DIGITS | {"."}, is_ipv4, DIGITS | {"."}, DIGITS),
        "card": (DIGITS | set(" -"), is_card, ALNUM | set(".-"), ALNUM),
        "ssn": (DIGITS | {"-"}, is_ssn, ALNUM | {"-"}, ALNUM),
        "date": (DIGITS | set("-./"), is_date, ALNUM | set("./-"), ALNUM),
    }[kind]
    more = {"email": "", "ipv4": ".", "card": ".-", "ssn": "-", "date": "./-"}[kind]
    out, s = [], 0
    while s < len(text):
        end = s
        while end < len(text) and text[end] in chars:
            end += 1
        hit = None
        if end > s and (s == 0 or text[s - 1] not in before):
            for e in range(end, s, -1):
                rest = text[e : e + 2]
                time = kind == "date" and rest[:1] in ("T", "t") and text[e + 1 : e + 3].isdigit() and len(text[e + 1 : e + 3]) == 2
                clear = not rest or rest[0] not in after and not (rest[0] in more and rest[1:] in DIGITS)
                if (clear or time) and ok(text[s:e]):
                    hit = (s, e)
                    break
        out += [hit] if hit else []
        s = hit[1] if hit else s + 1 if end == s or text[s] in chars else end
    return out


def test_the_given_texts_hold_what_an_own_finder_finds(spark, small):
    """Emails, addresses, cards, social security numbers and dates of sf0.001, less spans that an earlier kind has."""
    some = 0
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        text = r["text"] or ""
        new, spans = I.pseudonymise(text, N)
        assert I.pseudonymise(new, BACK)[0] == text
        for kind in ("email", "ipv4", "card", "ssn", "date"):
            earlier = [(s, e) for s, e, k, _ in spans if I.KINDS.index(k) < I.KINDS.index(kind)]
            want = [x for x in found_by_trying(text, kind) if not any(s < x[1] and x[0] < e for s, e in earlier)]
            got = [(s, e) for s, e, k, _ in spans if k == kind]
            assert got == want, (kind, [text[s:e] for s, e in set(got) ^ set(want)])
            some += len(want)
    assert some > 10


def test_values_before_other_groups_and_times():
    for text, value, kind in [
        ("4111 1111 1111 1111 12/27", "4111 1111 1111 1111", "card"), ("4111 1111 1111 1111 123", "4111 1111 1111 1111", "card"), ("no 1234 4111 1111 1111 1111 end", "4111 1111 1111 1111", "card"),
        ("BE68 5390 0754 7034 2024", "BE68 5390 0754 7034", "iban"), ("DE89 3704 0044 0532 0130 00 2024", "DE89 3704 0044 0532 0130 00", "iban"), ("at 2024-01-05T10:00:00Z.", "2024-01-05", "date"),
    ]:
        new, spans = I.pseudonymise(text, N)
        s = text.index(value)
        assert (s, s + len(value), kind) in [x[:3] for x in spans], text
        assert value not in new and new[s + len(value) :].startswith(text[s + len(value) :][:1])
        assert I.pseudonymise(new, BACK)[0] == text
    assert I.pseudonymise("2024-01-05T10:00:00Z", N)[0][:10] == I.pseudonymise("on 2024-01-05", N)[0][3:]
    assert I.pseudonymise("2024-01-05Term", N)[0] == "2024-01-05Term"
