"""JSON of listings and reports, and the texts of short ones, from collected and ordered rows."""

from __future__ import annotations

import json


def place(row) -> str:
    return f"{row['name']} ({row['file']}:{row['line_start']})"


def as_json(data) -> str:
    """Indented JSON; what is None is left out."""

    def bare(x):
        if isinstance(x, dict):
            return {k: bare(v) for k, v in x.items() if v is not None}
        return [bare(v) for v in x] if isinstance(x, list) else x

    return json.dumps(bare(data), indent=2, ensure_ascii=False)


def grouped(rows, key: str) -> dict:
    """Rows by a key, in the order in which keys first appear."""
    out: dict = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def route(row) -> str | None:
    return (row["metadata"] or {}).get("route")


def overview_data(flows, boundaries, events) -> dict:
    return {
        "flows": [{"name": r["value"], "entryPoint": r["name"], "file": r["file"], "line": r["line_start"], "route": route(r)} for r in flows],
        "boundaries": [{"system": r["value"], "function": r["name"], "file": r["file"], "line": r["line_start"]} for r in boundaries],
        "events": [
            {"event": r["event_name"], "emitter": r["emitter_name"], "emitterFile": r["emitter_file"], "handler": r["handler_name"], "handlerFile": r["handler_file"]}
            for r in events
        ],
    }


def arrow(depth: int) -> str:
    return "  " * depth + "→ " if depth else ""


def chain(nodes, boundary_of: dict[str, str]) -> str:
    """A path's nodes, each deeper than the one before."""
    return "\n".join(f"{arrow(i)}{place(n)}" + (f" [{boundary_of[n['id']]}]" if n["id"] in boundary_of else "") for i, n in enumerate(nodes))


def context_data(node, flows, callers, callees, boundary) -> dict:
    near = lambda rows: [{"id": r["id"], "name": r["name"], "file": r["file"], "line": r["line_start"]} for r in rows]
    own = {"id": node["id"], "name": node["name"], "file": node["file"], "line": node["line_start"], "signature": node["signature"]}
    return {**own, "flows": flows, "callers": near(callers), "callees": near(callees), "boundary": boundary}


def lint(issues, coverage) -> str:
    """Errors and warnings; remarks are only counted in the JSON form."""
    out = []
    for severity, title in (("error", "Errors (must fix):"), ("warning", "Warnings (should fix):")):
        own = [r for r in issues if r["severity"] == severity]
        out += [title] if own else []
        for r in own:
            out += [f"  {r['file']}:{r['line']}  {r['symbol']}", f"    {r['message']}", ""]
    return "\n".join([*out, "Info:", f"  Coverage: {coverage['tagged']}/{coverage['total']} entry points tagged ({coverage['percent']}%)"])


def populate(marker: str, summary, tags) -> str:
    """Instructions for whoever tags a project: the tags, examples, the project's state, and how to go about it."""
    spec = f"""## Tags

Four tags, in comments right above a function:

- `{marker}flow <name>`: an entry point, where a business operation starts.
- `{marker}boundary <system>`: where code leaves the project for another system.
- `{marker}emits <event>`: publishes an event.
- `{marker}handles <event>`: consumes an event that some function emits.

Names are lowercase, with digits, dots, dashes and underscores; several are separated by commas.
Tag entry points and boundaries only: what lies between follows from the calls."""
    examples = f"""## Examples

```python
# {marker}flow checkout
def handle_checkout(request):
    return create_order(request)

# {marker}boundary stripe
def charge(amount, token):
    return stripe.charge(amount, token)

# {marker}emits order.created
def announce(order):
    bus.publish("order.created", order)
```"""
    lines = [f"{summary['files']} files, {summary['symbols']} symbols, {summary['edges']} call edges in the graph.", ""]
    if tags:
        lines += ["### Already tagged", "", *(f"- `{marker}{r['kind']} {r['value']}` on `{r['node_id']}`" for r in tags)]
    else:
        lines.append("No tags exist yet.")
    work = """## Steps

1. Find the entry points: routes, commands, jobs, consumers. Tag their flows.
2. Find the calls that leave the project. Tag their boundaries.
3. Match what is emitted with what handles it.
4. Build, lint, and mend what lint reports."""
    return "\n\n".join([spec, examples, "## This project\n\n" + "\n".join(lines), work])
