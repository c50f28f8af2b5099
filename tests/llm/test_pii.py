"""Plain identifiers against their grammars, disguises one by one, and the way back to the source."""

import random
import re

import pytest

from tracewell.llm import pii

from .test_llm import documents, odd

GRAMMAR = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(kind, found):
    digits = [int(d) for d in re.sub("[^0-9]", "", found)]
    if kind == 1:
        return all(int(p) <= 255 for p in found.split("."))
    if kind == 2:
        doubled = [2 * d - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == 0 or 8 <= len(digits) <= 15


def brute(text):
    return [(k, *m.span()) for k, g in enumerate(GRAMMAR) for m in re.finditer(g, text) if passes(k, m.group())]


def test_plain_equals_the_grammars():
    rng = random.Random(4)
    for alphabet in ("a@.b-", "01.2 ", "0459 -+", "+1() .-9", "a@b.c1+2 3.4-"):
        for n in range(0, 60):
            for _ in range(40):
                text = "".join(rng.choice(alphabet) for _ in range(n))
                assert pii.plain(text) == brute(text), text
    for text in ("a@b.c@d.e", "@x.y", "a@b.c.", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "01.002.0255.255", "4111 1111-1111 1111", "+1 2345678", "+12 (34) 567.8-9 ", "x" * 200 + "@y.z"):
        assert pii.plain(text) == brute(text), text


DISGUISED = {
    "email": ("jane.doe (at) mail (dot) example (dot) com", "jane[at]example.com", "jane {AT} example {DOT} com", "jane at mail dot example dot com", "jane dot doe at example dot org", "jane_at_example_dot_com", "jane @ example . com", "jane(@)example.com",
              "jane arroba example punto com", "jane arobase example point fr", "jane ät example punkt de", "jаne@exаmple.com", "ｊａｎｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ja​ne@exam­ple.com"),
    "ip": ("192[.]168[.]0[.]1", "192 dot 168 dot 0 dot 1", "one nine two dot one six eight dot zero dot one", "１９２.１６８.０.１", "10(dot)0(dot)0(dot)7"),
    "card": ("four one one one one one one one one one one one one one one one", "４１１１ １１１１ １１１１ １１１１", "4111 1111 1111 1111", "4111 llll 1111 1111", "4111‑1111‑1111‑1111"),
    "phone": ("plus one four one five five five five one two three four", "+1 (4l5) 555-O123", "＋１ （４１５） ５５５ ２６７１", "plus vier neun eins fünf fünf eins zwei drei vier", "plus four nine double five one two three four five six", "+١ ٤١٥ ٥٥٥ ٢٦٧١"),
}


@pytest.mark.parametrize(("kind", "text"), [(k, t) for k, texts in DISGUISED.items() for t in texts])
def test_disguises_are_found_at_their_places(kind, text):
    for before, after in (("", ""), ("Write to ", " today."), ("日本 é\n", "\nend"), ("🙂 ", " 🙂")):
        base, spans = pii.scan(before + text + after)
        assert base == [] and spans == [(pii.KINDS.index(kind), len(before), len(before) + len(text))], before


@pytest.mark.parametrize("text", ["erst at anonen. Look at the dot.", "Meet at noon dot dot dot", "one, two, three, four, five", "иван пишет на почту.", "See Section 1.2.3 at Example.com", "x (at) y", "π ≈ 3.14159265358979", "v1.2.3 of 2024-01-02 at 10.30", "double or nothing, one on one, point by point", "l0l 100 I 200 O 300", "日本語の文章。", "at dot com", "one two three four five six seven eight"])
def test_clean_texts_stay_clean(text):
    assert pii.scan(text) == ([], [])


def test_plain_spans_stay_beside_wider_ones():
    base, spans = pii.scan("jane(dot)doe@example.com")
    assert base == [(0, 9, 24)] and spans == [(0, 0, 24), (0, 9, 24)]
    text = "jane@example.com, p (at) q (dot) org, +1 415 555 2671, 10.0.0.1"
    base, spans = pii.scan(text)
    assert set(base) < set(spans) and [text[a:b] for k, a, b in spans if (k, a, b) not in base] == ["p (at) q (dot) org"]


def test_the_way_back():
    made = pii.Rewritten("a--b+++c", [(1, 3, ""), (4, 7, "xy")])
    assert made.text == "abxyc" and [made.back(i, i + 1) for i in range(5)] == [(0, 1), (3, 4), (4, 7), (4, 7), (7, 8)] and made.back(0, 5) == (0, 8)


def test_long_texts_take_linear_time():
    for unit in ("a", "1", "1.", "a@", "+1 ", "(at", " dot", "one ", "[", " ", "а", "​", "a_at_"):
        pii.scan(unit * 100_000)


def test_rows(spark, tiny):
    for df in (odd(spark), documents(spark, tiny), odd(spark).limit(0)):
        rows = pii.identifiers(df).join(df.select("doc_id", "text"), "doc_id").collect()
        assert all([tuple(x) for x in r.base] == brute(r.text or "") and set(map(tuple, r.base)) <= set(map(tuple, r.spans)) for r in rows)
        assert pii.identifiers(df).count() == df.count()
