"""Decoding against every possible choice, and pages of all lengths, with odd attributes or without any markup."""

import random
from itertools import product

import numpy as np
import pytest

from quillspark.llm import extract
from quillspark.llm.dom import Node

NAV = "<nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>Menu two</a></li></ul></nav>"
FOOTS = ["<footer>&copy; 2024 Somebody, all rights.</footer>", "<div class='footer'><p>Contact us, imprint and terms.</p></div>", "<section class='comments'><h3>Comments</h3><div class='comment'><p>I like it a lot.</p></div></section>"]


def test_decoding_is_the_best_choice_without_contradictions():
    r = random.Random(2)
    for _ in range(60):
        nodes = [Node("", "", -1, 0, 0)]
        for i in range(1, r.randint(2, 9)):
            up = r.randrange(i)
            nodes.append(Node("div", "", up, nodes[up].depth + 1, i))
            nodes[up].children.append(i)
        odds = np.array([r.choice([-2, -1, 0.5, 1, 3]) + r.random() / 8 for _ in nodes[1:]])
        best = max((c for c in product([False, True], repeat=len(nodes) - 1) if all(not k or nodes[i].parent == 0 or c[nodes[i].parent - 1] for i, k in enumerate(c, 1))), key=lambda c: sum(o for o, k in zip(odds, c) if k))
        assert extract.decode(nodes, odds)[1:] == list(best)


@pytest.mark.parametrize("n", [10, 1000, 10000])
@pytest.mark.parametrize("foot", FOOTS)
def test_articles_of_any_length(n, foot):
    paras = [f"Paragraph {i} of the story, with some words in it." for i in range(n)]
    page = f"<!DOCTYPE html><html><head><title>no</title></head><body>{NAV}<article><h1>A title</h1>" + "".join(f"<p>{p}</p>" for p in paras) + f"</article>{foot}</body></html>"
    assert extract.main_texts([page], extract.trained())[0].split("\n") == ["A title", *paras]


def test_attributes_are_told_apart():
    plain = extract._tokens("")
    assert extract._tokens(' data-id="comments-7"') == extract._tokens(' title="a class=comments b"') == extract._tokens(" xclass=comments") == plain
    assert extract._tokens(' data-x=1 class="comments"')[0] == extract._tokens(" ID='comments-7'")[0] != plain[0]
    assert extract._tokens(" hidden")[1] == extract._tokens(" style='display: none'")[1] == 1 and extract._tokens(" data-hidden")[1] == 0


def test_text_without_blocks():
    got = extract.main_texts(["just text &amp; more", "<b>Hello</b>  there", "  ", "<script>no</script>"], extract.trained())
    assert got == ["just text & more", "Hello there", "", ""]
