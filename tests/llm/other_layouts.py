"""Pages of other layouts than those that op9's weights are fitted to: tables and bare divisions, few names, line breaks for paragraphs."""

import random
from html import escape

WORDS = "river market window paper garden history number letter moment winter station village teacher question answer morning picture music doctor travel".split()


def sentence(draw, least=6, most=22):
    words = [draw.choice(WORDS) for _ in range(draw.randint(least, most))]
    for i in range(3, len(words), 7):
        words[i] += ","
    return " ".join(words).capitalize() + draw.choice([".", ".", ".", "?", "!"])


def paragraph(draw):
    return " ".join(sentence(draw) for _ in range(draw.randint(1, 5)))


def links(draw, n, sep=" "):
    return sep.join(f'<a href="/{draw.randrange(999)}">{draw.choice(WORDS).capitalize()} {draw.choice(WORDS)}</a>' for _ in range(n))


def article(draw):
    """(html, its blocks)."""
    head = " ".join(draw.choice(WORDS) for _ in range(draw.randint(3, 8))).capitalize()
    kind, out, parts = draw.choice(["p", "div", "section"]), [head], []
    tag = draw.choice(["h1", "h1", "h2"])
    for _ in range(draw.randint(2, 9)):
        roll = draw.random()
        if roll < 0.15:
            out.append(" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 4))).capitalize())
            parts.append(f"<h3>{out[-1]}</h3>")
        elif roll < 0.25:
            items = [sentence(draw, 2, 9) for _ in range(draw.randint(2, 4))]
            out += items
            parts.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
        elif roll < 0.35:
            out.append(sentence(draw, 1, 4))
            parts.append(f"<{kind}>{out[-1]}</{kind}>")
        else:
            text = paragraph(draw)
            out.append(text)
            shown = text.replace(WORDS[0], f'<a href="/x">{WORDS[0]}</a>', 1) if draw.random() < 0.2 else text
            parts.append(f"<{kind}>{shown}</{kind}>")
    return f"<{tag}>{escape(head)}</{tag}>" + "".join(parts), out


def page(draw):
    """(html, the blocks of its main text)."""
    body, want = article(draw)
    menu = draw.choice([f"<div>{links(draw, 6, ' | ')}</div>", f"<ul>{''.join(f'<li>{links(draw, 1)}</li>' for _ in range(7))}</ul>", f"<div>{links(draw, 5, '</div><div>')}</div>"])
    more = draw.choice(["", f"<div><b>See also</b></div><div>{links(draw, 4, '<br>')}</div>", f"<p>{links(draw, 8)}</p>"])
    foot = draw.choice(["<div>Copyright 2024 The Paper</div>", "<center>Contact | Imprint | Terms</center>", f"<div>{links(draw, 4, ' - ')}</div>", "<p>© 2025 by us</p>"])
    layout = draw.randrange(4)
    if layout == 0:
        html = f"<table><tr><td colspan=2>{menu}</td></tr><tr><td>{links(draw, 9, '<br>')}</td><td>{body}</td></tr><tr><td colspan=2>{more}{foot}</td></tr></table>"
    elif layout == 1:
        html = f"<div><div>{menu}</div><div><div>{body}</div></div><div>{more}</div><div>{foot}</div></div>"
    elif layout == 2:
        html = f"{menu}<div id=c1>{body}</div><div id=c2>{more}</div>{foot}"
    else:
        html = f"<header>{menu}</header><main>{body}</main><aside>{more}<p>{paragraph(draw)}</p></aside><footer>{foot}</footer>"
    return f"<!DOCTYPE html><html><head><title>{escape(want[0])}</title></head><body>{html}</body></html>", want


def pages(n, seed=1):
    draw = random.Random(seed)
    return [page(draw) for _ in range(n)]
