"""Labelled pages for the main text of HTML pages (operator 9), written for this purpose.

A page is put together from sentences and from parts that pages have: menus, notices, headings, paragraphs, lists, teasers,
comments, footers. Each block starts with + (main text) or - (not). Three of four pages have neither article nor main, and
their class names say nothing; there, only counts, densities, neighbours and kinds of elements tell blocks apart.
"""

from __future__ import annotations

import random

SENTENCES = tuple(
    """
The council met on Tuesday to discuss the new bridge and voted to fund repairs over three years.
Nobody had expected the river to rise again before the end of the month.
Farmers in the valley moved their animals to higher ground while it was still light.
A small bakery near the station has sold the same dark bread for ninety years.
Its owner says that she has never written the recipe down and does not plan to.
Scientists measured the depth of the lake at forty places and found it shallower than before.
The measurements, which took most of a summer, will be repeated in two years.
We walked along the coast until the path ended at an old lighthouse without a door.
It rained.
Inside there were nests, a broken chair and a calendar that stopped in the spring of 1974.
The software reads a table of readings every hour and writes a short report when a value is out of range.
If the network fails, the report waits on disk and is sent as soon as a connection comes back.
Most users never change the default settings, although the manual explains each of them in detail.
In the second half the visitors attacked with more patience and scored twice within five minutes.
Their coach praised the young goalkeeper, who had joined the team only a week earlier.
Prices for copper fell for the third day in a row as stocks in the warehouses grew.
Analysts had forecast the opposite, and several of them lowered their estimates for the year.
Boil the beans for an hour, drain them, and keep a cup of the water for the sauce.
Add the garlic late so that it does not burn.
The museum opens its new wing with drawings that were hidden in a bank vault during the war.
Visitors may look at them for ten minutes each because the paper does not bear much light.
After the concert the orchestra stayed on stage and played the slow movement once more for those who had waited.
Trains between the two cities will run every half hour from December on, also at night.
The company that builds the cars has delivered only nine of the thirty that were ordered.
Her first novel tells of three sisters who inherit a hotel on an island that no ferry serves any longer.
Critics disagreed about the ending, but all of them admired the chapters on the storm.
Children at the school plant a tree each autumn and measure how far the older ones have grown.
This year it was a walnut.
""".strip().split("\n")
)
TITLES = ("Results", "A day out", "Bridge to be repaired", "What we found in the lake this summer", "Rain", "How the report is made and sent", "Next steps", "Bread for ninety years", "Notes")
SHORT = ("Yes.", "Done.", "That was all.", "More tomorrow.", "No one knows why.", "It worked.")
ITEMS = ("two cups of flour", "one onion", "a long rope", "the old map", "salt", "three days of food")
LABELS = ("Home", "News", "Sport", "Weather", "Travel", "Contact", "About us", "All topics", "Sign in", "Archive", "Imprint", "Terms of use", "Privacy")
LEGAL = ("All rights reserved by the publisher of this page.", "&copy; 2024 the makers of this page, printed with care in a small town by the sea.", "Imprint and contact by mail only.")
NOTICES = ("We use cookies to make this page work and to see how it is used.", "Your session will end in ten minutes unless you go on.", "This page looks best in a new browser.")
CLASSES = ("", " class=x7", " class='css-1q2 b'", " class=row", " class='wrap inner'", " id=c4")
NAMED = ("cookie-notice", "sidebar", "comments", "site-footer", "related-posts", "newsletter", "ad", "main-nav", "share", "search-form")
ROLES = ("aside", "footer", "nav")


def labelled_page(seed: int, sentences: tuple[str, ...] = SENTENCES) -> str:
    """The page of a seed."""
    rng = random.Random(seed)
    style = ("article", "main", "plain", "plain", "plain", "plain", "plain", "plain")[seed % 8]
    inside = style != "plain"

    def some(least: int, most: int) -> str:
        return " ".join(rng.choice(sentences) for _ in range(rng.randint(least, most)))

    def div(content: str) -> str:
        return f"<div{rng.choice(CLASSES)}>{content}</div>"

    def menu() -> str:
        labels = rng.sample(LABELS, rng.randint(2, 6))
        kind = rng.randrange(4)
        if kind == 0:
            return "<ul>" + "".join(f"<li><a>-{x}</a></li>" for x in labels) + "</ul>"
        if kind == 1:
            return div("-" + " ".join(labels))
        links = " ".join(f"<a>{x}</a>" for x in labels)
        return f"<nav><p>-{links}</p></nav>" if kind == 2 else div(links.replace("<a>", "<a>-", 1))

    def furniture() -> str:
        name = rng.choice(ROLES) if rng.random() < 0.5 else ""
        start, end = (f"<{name}>", f"</{name}>") if name else (f"<div class='{rng.choice(NAMED)}'>", "</div>")
        title = f"<h2>-{rng.choice(TITLES)}</h2>" if rng.random() < 0.3 else ""
        return start + title + "".join(f"<p>-{some(1, 3)}</p>" for _ in range(rng.randint(1, 3))) + end

    def teasers() -> str:
        one = lambda: f"<h3><a>-{rng.choice(TITLES)}</a></h3><p>-{rng.choice(sentences)}</p><p><a>-Read more</a></p>"
        return div("".join(one() for _ in range(rng.randint(1, 3))))

    def part() -> str:
        kind = rng.randrange(10 if inside else 8)
        if kind < 3:
            return f"<p>+{some(1, 3)}</p>"
        if kind == 3:
            return f"<h2>+{rng.choice(TITLES)}</h2><p>+{some(1, 2)}</p>"
        if kind == 4:
            return f"<p>+{some(1, 2)}</p><p>+{rng.choice(SHORT)}</p>"
        if kind == 5:
            return f"<p>+{some(1, 2)} <a>{rng.choice(TITLES)}</a> {rng.choice(sentences)}</p>"
        if kind == 6:
            return f"<p>+{some(1, 2)}</p><ul>" + "".join(f"<li>+{x}</li>" for x in rng.sample(ITEMS, 3)) + "</ul>"
        if kind == 7:
            return div("+" + some(3, 5))
        if kind == 8:
            return "<ul>" + "".join(f"<li><a>+{x}</a></li>" for x in rng.sample(TITLES, 2)) + "</ul>"
        return f"<table><tr><td>+{rng.choice(ITEMS)}</td><td>+{rng.choice(SHORT)}</td></tr></table>"

    body = "".join(part() for _ in range(rng.randint(1, 6)))
    if rng.random() < 0.8:
        body = f"<h1>+{rng.choice(TITLES)}</h1>" + body
    elif rng.random() < 0.5:
        body = "".join(f"<p>+{x}</p>" for x in rng.sample(SHORT, rng.randint(1, 3)))
    if inside:
        body = body if rng.random() < 0.7 else f"<p>+{some(1, 2)}</p>"  # also pages of one paragraph
        inner = f"<div class='{rng.choice(('header-image', 'form-group', 'text', 'post-body'))}'>{body}</div>" if rng.random() < 0.4 else body
        body = f"<{style}>{inner}{'<button>-Press</button>' if rng.random() < 0.3 else ''}{furniture() if rng.random() < 0.3 else ''}</{style}>"
    else:
        body = div(body)
    if rng.random() < 0.15:  # a page of text alone
        return "<body>" + (body if rng.random() < 0.5 or inside else "".join(f"<p>+{x}</p>" for x in rng.sample(SHORT + sentences, rng.randint(1, 4))))
    before = [x for x, chance in ((div(f"<p>-{rng.choice(NOTICES)}</p><p><a>-Accept</a></p>"), 0.3), (menu(), 0.7), (furniture(), 0.2)) if rng.random() < chance]
    after = [x for x, chance in ((teasers(), 0.4), (furniture(), 0.4), (menu(), 0.4)) if rng.random() < chance]
    if rng.random() < 0.6:
        legal = rng.choice(LEGAL)
        after.append(f"<footer>-{legal}</footer>" if rng.random() < 0.4 else div("-" + legal))
    return "<body>" + "".join(before) + body + "".join(after)
