"""Inputs made to exhaust a parser, and characters that look like letters."""

import struct

import pytest

from cohortlens.llm import media, ngrams, tokencount, wrappers


def text(html):
    page = wrappers.parse(html)
    return wrappers.main_text(page, wrappers.mark(wrappers.item(page)))


@pytest.mark.parametrize(
    ("html", "expected"),
    [
        ("<div>" * 10_000 + "deep" + "</div>" * 10_000 + "<p>after</p>", "deep after"), ("<ul><li>" * 5_000 + "x", "x"),
        ('<p>a</p><a href="x' * 50_000 + "><p>b</p>", None), ("<script>" + "</script " * 100_000, ""), ("<p>a <!-- <p>b</p>", "a"), ("<article>a <a title='b > c'>d</a></article>", "a d"),
    ],
)
def test_pages_of_any_depth_and_without_ends(html, expected):
    found = text(html)
    assert expected is None or found == expected


def test_a_megabyte_of_tags_that_never_end_is_text():
    assert len(text("<a " * 350_000)) > 1_000_000


def test_children_keep_their_order():
    names = [f"w{i}" for i in range(5_000)]
    assert text("<article>" + "".join(f"<h2>{x}</h2>" if i % 3 else f"<p>{x}</p>" for i, x in enumerate(names)) + "</article>").split() == names


def test_boxes_of_any_depth_and_forged_counts():
    nested = b""
    for _ in range(10_000):
        nested = media.box(b"moov", nested)
    with pytest.raises(ValueError, match="no track"):
        media.described(nested)
    data = bytearray(media.container(b"x" * 6400))
    at = data.index(b"stsz") + 8
    data[at:at + 8] = struct.pack(">II", 64, 2**32 - 1)
    with pytest.raises(ValueError, match="larger than the file"):
        media.described(bytes(data))


def test_numbers_are_no_letters():
    assert ngrams.words_of("² ½ Ⅷ ①") == [] and ngrams.words_of("a²b É") == ["a", "b", "é"]


def test_control_and_byte_pieces_match_no_text():
    pieces = {p for p, _ in tokencount.vocabulary()}
    assert not pieces & {"<unk>", "<s>", "</s>", "<0x41>"} and "▁the" in pieces
