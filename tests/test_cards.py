from __future__ import annotations

from chorusmill.sources import cards


def card(cid, author, text, reply=True, inner="", more=""):
    control = '<div role="button"><span>Reply</span></div>' if reply else ""
    return f'<div><a href="/{author}/"><img alt="x"></a><span><a href="/{author}/">{author}</a> <span>Verified</span></span><div>{text}</div><span><a href="/p/AB/c/{cid}/"><time datetime="2024-01-0{cid[-1]}">3d</time></a></span>{more}{control}</div>{inner}'


HEAD = '<html><head><title>t</title><link rel="canonical" href="https://www.instagram.com/p/AB/"><meta property="og:url" content="https://www.instagram.com/p/AB/"></head><body>'


def rows(*pages):
    return [cards._read(p)[3] for p in pages]


def test_cards_with_replies():
    replies = "<ul><li>" + card("12", "bob.b", "a reply<br>on two lines", more="<div><button>Like</button></div><div><span>4 likes</span></div>") + "</li><li>" + card("13", "cy", "another &amp; one") + "</li></ul>"
    page = HEAD + "<article><header><a href='/owner/'>owner</a></header><ul><li>" + card("11", "ann", "first <b>words</b>", inner=replies) + "</li><li>" + card("14", "dee", "View translation is fine") + "</li></ul></article></body></html>"
    first, bob, cy, dee = cards._read(page)[3]
    assert (first["comment_id"], first["author"], first["depth"], first["parent_comment_id"], first["published_at"], first["published_label"]) == ("11", "ann", 0, None, "2024-01-01", "3d")
    assert first["comment_text"] == "first words" and first["comment_url"] == "https://www.instagram.com/p/AB/c/11/"
    assert (bob["comment_text"], bob["parent_comment_id"], bob["depth"], bob["like_count"]) == ("a reply on two lines", "11", 1, "4")
    assert (cy["comment_text"], cy["parent_comment_id"]) == ("another & one", "11") and (dee["parent_comment_id"], dee["comment_text"]) == (None, "View translation is fine")


def test_list_items_where_no_card_has_a_control():
    page = '<article><ul><li data-comment-id="7" data-parent-comment-id="6"><a href="https://www.instagram.com/eve/">eve</a><p>hello there</p></li><li>no author</li><li><a href="/fay/">fay</a></li></ul></article><ul><li><a href="/out/">out</a><p>not of the post</p></li></ul>'
    (only,) = cards._read(page)[3]
    assert (only["comment_id"], only["parent_comment_id"], only["author"], only["comment_text"], only["published_at"]) == ("7", "6", "eve", "hello there", None)
    assert rows(None, "", "<p>x", "<li><ul><time datetime=1>", "</div></ul>") == [[], [], [], [], []]
    assert len(cards._read("<article><ul>" + "<li><div><a href=/a/>a</a><div>text</div>" * 3000)[3]) >= 1  # broken and deep


def test_pages_that_disagree_have_no_comments(spark):
    page = HEAD + card("11", "ann", "words") + "</body>"
    table = spark.createDataFrame([("https://www.instagram.com/p/AB/", page), ("https://www.instagram.com/p/OTHER/", page), ("https://www.instagram.com/reel/AB/", page), (None, page), ("https://www.instagram.com/p/AB/", None)], "url string, html string")
    got = cards.page_captures(table).collect()
    assert [len(r["comments"]) for r in got] == [1, 0, 1, 0, 0] and [r["identity"]["reason"] for r in got] == ["verified", "MEDIA_ID_MISMATCH", "verified", "MEDIA_ID_MISMATCH", "identity_evidence_not_ready"]
    shown = cards.comment_cards(table).collect()
    assert [(r["media_id"], r["pos"], r["comment_text"]) for r in shown] == [("AB", 0, "words")] * 2
