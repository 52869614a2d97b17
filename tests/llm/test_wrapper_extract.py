from hypothesis import given, settings
from hypothesis import strategies as st

from pagequarry.llm import wrapper_extract as X


def page(title, paragraphs, extra="", cut=None):
    body = "".join(f"<p>{p}" for p in paragraphs)
    html = f"<html><head><title>{title}</title><script>var a='<p>x</p>'</script></head><body><nav><ul><li><a href=/>Home</a><li>Menu</ul></nav><!-- <p>no</p> --><div class='cookie-notice'>We use cookies</div>{extra}<article><h1>{title}</h1>{body}</article><section id=comments><p>reader says</p></section><footer>&copy; me</footer></body></html>"
    return html[:cut]


def test_main_text(spark):
    rows = [
        (1, "http://a.org/1", page("One &amp; only", ["first  <b>bold", "sec<i>ond</i><br>line"])),
        (2, "http://A.org/2", page("Two", ["x"], extra="<aside>side</aside><form>f <input></form>")),
        (3, "http://a.org/3", page("Three", ["a", "b", "c", "d"])[:-60]),
        (4, "http://b.org/", "<div class=menu>m</div><div><h2>Head</h2><p>text one</p></div>"),
        (5, "http://b.org/2", "<div class=menu>m</div><div><h2>Other</h2><p>text two</p><p>more</p></div>"),
        (6, None, None),
        (7, "x", ""),
        (8, "http://a.org/4", page("Cut", ["aa"], cut=200)),
        (9, "http://a.org/1", page("One &amp; only", ["first  <b>bold", "sec<i>ond</i><br>line"])),
    ]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    found = {r.page_id: (r.text, r.n_chars, r.url) for r in X.main_text(pages).collect()}
    want = {1: "One & only first bold second line", 2: "Two x", 3: "Three a b c d", 4: "Head text one", 5: "Other text two more", 6: "", 7: "", 8: "", 9: "One & only first bold second line"}
    assert {k: v[0] for k, v in found.items()} == want
    assert all(v[1] == len(want[k]) and v[2] == dict((r[0], r[1]) for r in rows)[k] for k, v in found.items())


def texts(*pages):
    """The texts of a host's pages."""
    wrapper = X.expression(pages[0])
    for p in pages[1:]:
        wrapper = X.align(wrapper, X.expression(p))
    paths = frozenset(X.main_paths(wrapper))
    return [X.extract(p, paths) for p in pages]


def test_each_page_decides_whether_it_has_a_container():
    old = "<body><div class=content><h1>Old {0}</h1><p>text {0}</p><p>more {0}</p></div></body>"
    assert texts(page("New", ["x"]), old.format(1), old.format(2)) == ["New x", "Old 1 text 1 more 1", "Old 2 text 2 more 2"]
    # articles that are teasers or readers' comments don't replace the text beside them
    teasers = "<div class=latest><article><p>one</p></article><article><p>two</p></article></div>"
    comment = "<div class=thread><article class=comment><p>A reader says much more than the text does.</p></article></div>"
    found = texts(*(f"<body><div class=content><h1>T{k}</h1><p>text {k}</p></div>{x}</body>" for k, x in enumerate([teasers, comment, "<article><p>see</p></article>"])))
    assert all(t.startswith(f"T{k} text {k}") for k, t in enumerate(found))


def test_constant_text_is_the_templates_only_if_pages_differ():
    one = "<body><div class=content><h1>Title</h1><p>a</p><p>b</p><blockquote>alone</blockquote></div></body>"
    assert texts(one) == ["Title a b alone"]
    assert texts(one, one) == ["Title a b alone"] * 2
    many = "<body><div class=top>My site</div><div class=content><h1>Title {0}</h1><p>the same</p></div></body>"
    assert texts(many.format(1), many.format(2)) == ["Title 1 the same", "Title 2 the same"]


def test_layout_names_bar_nothing():
    for name in ("has-sidebar", "no-sidebar", "with-header", "ad-free", "menu-open", "post-header"):
        assert texts(f"<body><div class='{name}'><article><h1>T</h1><p>text</p></article></div></body>") == ["T text"], name
        assert texts(f"<body><article><div class='{name}'><h1>T</h1></div><p>text</p></article></body>") == ["T text"], name
        assert texts(f"<body><div class='{name}'><h1>T</h1><p>text</p></div></body>") == ["T text"], name
    for outer in ("div class=sidebar", "form id=page", "div class=banner-ad"):
        assert texts(f"<body><{outer}><article><p>text</p></article></{outer.split()[0]}></body>") == ["text"], outer
    assert texts("<body><aside><main><p>text</p></main></aside></body>") == ["text"]


def test_names_of_several_words_bar():
    for name in ("cookie-notice", "site-footer", "main-nav", "share_buttons", "comment-list", "related-posts"):
        assert texts(f"<body><div><h1>T</h1><p>text</p></div><div class={name}><p>no</p></div></body>") == ["T text"], name
    for name in ("comment-list", "related-posts", "comments"):
        assert texts(f"<body><div><h1>T</h1><p>text</p></div><div class={name}><article><p>no</p></article></div></body>") == ["T text"], name


def test_quotes_inside_tags():
    assert texts("<body><p title=Bob's>one</p><p>two</p><p>it's three</p></body>") == ["one two it's three"]
    assert texts("<body><p title='a>b' class=\"c>d\">one</p><p x=y='z>two</p></body>") == ["one two"]


def test_wrapper_has_slots_groups_and_options():
    pages = [page("A", ["x", "y"]), page("B", ["z"], extra="<aside>s</aside>")]
    wrapper = X.align(*(X.expression(p) for p in pages))
    pattern = X.to_pattern(wrapper)
    assert "(<p> #PCDATA </p>)+" in pattern and '(<aside> "s" </aside>)?' in pattern and "<h1> #PCDATA </h1>" in pattern and '(<li> #PCDATA </li>)+' in pattern


def test_alignment_is_idempotent():
    wrapper = X.align(X.expression(page("A", ["x", "y"])), X.expression(page("B", ["z"])))
    assert X.align(wrapper, wrapper) == wrapper


@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "<div class=x>", "</div>", "<li>", "<ul>", "</ul>", "<td>", "<tr>", "<script>", "</script>", "text ", "&amp;", "<!--", "-->", "<br/>", "<", "<a href='"]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_events_nest(tokens):
    open_now = []
    for kind, what in X.events("".join(tokens)):
        if kind == 1:
            open_now.append(what)
        elif kind == -1:
            assert open_now.pop() == what
    assert not open_now
    X.main_paths(X.expression("".join(tokens)))


def test_very_deep_and_long():
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after</p>"
    paths = frozenset(X.main_paths(X.expression(deep)))
    assert X.extract(deep, paths) == "deep after"
    long = "<article>" + "<p>word</p>" * 30000 + "</article>"
    assert X.extract(long, frozenset(X.main_paths(X.expression(long)))) == " ".join(["word"] * 30000)


def test_no_pages(spark):
    assert X.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
@settings(max_examples=200, deadline=None)
def test_common_parts_are_a_longest_subsequence(x, y):
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x)):
        for j in range(len(y)):
            best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
    found = X._common(x, y)
    assert len(found) == best[-1][-1] and all(x[i] == y[j] for i, j in found)
    assert all(a < c and b < d for (a, b), (c, d) in zip(found, found[1:]))


def test_barred_elements_at_any_depth():
    page = "<div>" * 130 + "<nav>MENU</nav><p>text</p><div class=sidebar>more<p>links</p></div>" + "</div>" * 130 + "<p>after</p>"
    paths = frozenset(X.main_paths(X.expression(page)))
    assert X.extract(page, paths) == "text after"


def test_plain_wrappers_of_any_number():
    """However many plain elements stand around a page, its text is the same."""
    from pagequarry.llm import wrapper_extract as W

    def page(n, k):
        return "<html><body>" + "<div>" * n + f"<p>beside {k}</p><article><h1>Title {k}</h1><p>Text {k} of the article, long enough to count.</p><div><div>in {k}</div></div></article><div class=ad>buy</div>" + "</div>" * n + "</body></html>"

    for n in (2, 59, 130, 5000):
        wrapper = W.align(W.expression(page(n, 1)), W.expression(page(n, 2)))
        paths = frozenset(W.main_paths(wrapper))
        assert W.extract(page(n, 3), paths) == "Title 3 Text 3 of the article, long enough to count. in 3", n
