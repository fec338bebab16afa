from vellum.operators.chunking import chunks, hashed_embedding, html_to_markdown, markdown_table, n_tokens, sections


def test_sections_and_bold_headings():
    text = "intro\n# One\nbody one\n**Two**\nbody two\n**Note:**\nstill two\n```\n# not a heading\n```\n#### deep stays"
    assert [h for h, _ in sections(text)] == [None, "One", "Two"]
    assert "# not a heading" in sections(text)[2][1] and "#### deep stays" in sections(text)[2][1]


def test_chunks_keep_every_sentence_within_the_limit():
    text = "# Head\n" + " ".join(f"Sentence number {k} says a thing." for k in range(900))
    got = chunks(text, 200)
    assert len(got) > 5 and all(n_tokens(c["chunk_text"]) <= 220 and c["section_heading"] == "Head" for c in got)
    assert all(any(f"number {k} " in c["chunk_text"] for c in got) for k in range(900))


def test_tables_code_and_long_pieces():
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| row{k} | {'x' * 50} |" for k in range(60))
    got = chunks(table, 200)
    assert len(got) > 2 and all(c["chunk_text"].startswith("| a | b |") and c["chunk_type"] == "table" for c in got)
    code = chunks("```\n" + "line of code\n" * 400 + "```", 200)
    assert all(c["chunk_text"].startswith("```") and c["chunk_text"].endswith("```") for c in code)
    assert chunks("") == [] and chunks("ab") == []


def test_html():
    page = "<html><head><title>no</title></head><body><nav>menu</nav><!-- c --><h1>T</h1><p>a <b>b</b></p><ul><li>x<ul><li>y</li></ul></li></ul><ol><li>1st</li></ol><table><tr><th>h|</th><th colspan=2>i</th></tr><tr><td>1</td></tr></table><img src='/p/q.png' alt='pic'><pre>code</pre></body></html>"
    got = html_to_markdown(page)
    for part in ("# T", "a **b**", "- x", "  - y", "1. 1st", "| h\\| | i | i |", "| 1 |  |  |", "[Image: pic (q.png)]", "```\ncode\n```"):
        assert part in got, (part, got)
    assert "menu" not in got and "no" not in got and html_to_markdown(None) == ""
    assert markdown_table([["", " "]]) == ""


def test_embedding():
    v = hashed_embedding("Some words here")
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and v == hashed_embedding("some WORDS here") and not any(hashed_embedding(""))
