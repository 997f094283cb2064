"""The pattern of a page's tags does not go back over what it has read."""

import random
import re
import time

from postmill.operators import cards

PIECES = ("<a ", "<li", "</a", "</li>", "<!--", "-->", "<!x", "<?x>", ">", "/>", "href=", "'", '"', "x", " ", "=", "\n", "class='q'", 'title="x>y"', "<script", "</script>", "<1")
BACKING = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][a-zA-Z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)


def test_tags_are_those_of_the_pattern_that_goes_back():
    pick = random.Random(2)
    told = lambda pattern, page: [(m.span(), m.groups()) for m in pattern.finditer(page)]
    for _ in range(20_000):
        page = "".join(pick.choice(PIECES) for _ in range(pick.randint(1, 14)))
        assert told(cards._TAG, page) == told(BACKING, page), page


def test_a_tag_that_never_ends_is_read_in_linear_time():
    began = time.time()
    assert cards.links_of("<a " + "x" * 300_000) == [] and cards.links_of("<a " + "x='y' " * 60_000) == []
    assert time.time() - began < 20


def test_links_are_handed_on_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(cards, "TOGETHER", 3)
    pages = spark.createDataFrame([(i, "https://x.org/", "".join(f"<li><a href='/{i}/{k}'>t</a></li>" for k in range(i % 5))) for i in range(40)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.pos, r.href) for r in cards.linked_cards(pages).collect())
    assert got == [(i, k, f"/{i}/{k}") for i in range(40) for k in range(i % 5)]
