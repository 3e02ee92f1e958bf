"""The pages of graphs and of texts: styles, a layout, and scripts of our own around data that Spark puts in."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape

#: Colours of the two themes.
THEMES = {
    "light": {"paper": "#ffffff", "ink": "#1c2430", "line": "#9aa7b5", "panel": "#f1f4f7", "augmented": "#c2571a"},
    "dark": {"paper": "#141a21", "ink": "#e4e9ef", "line": "#5c6b7a", "panel": "#1f2832", "augmented": "#f0935a"},
}
#: Edges up to which a page shows their labels without being asked.
MOST_EDGE_LABELS = 50


def stylesheet(dark: bool = False) -> str:
    """The page's styles, both themes in them; dark: the one that it opens with."""
    names = ("dark", "light") if dark else ("light", "dark")
    values = [";".join(f"--{k}:{v}" for k, v in THEMES[n].items()) for n in names]
    return (
        f":root{{{values[0]}}}:root.other{{{values[1]}}}"
        "body{margin:0;background:var(--paper);color:var(--ink);font:14px sans-serif}"
        "header,aside{background:var(--panel);padding:.5em 1em}header{display:flex;gap:.6em;align-items:center;flex-wrap:wrap}"
        "h1{font-size:1.1em;margin:0}svg{width:100%;height:calc(100vh - 9em);display:block;cursor:grab}"
        "line,path.e{stroke:var(--line);fill:none}.augmented{stroke:var(--augmented);stroke-dasharray:5 3}"
        "text{fill:var(--ink);font-size:11px;pointer-events:none}circle{stroke:var(--paper);cursor:pointer}"
        ".dim{opacity:.12}.path{stroke-width:3}mark{padding:0 .2em;border-radius:.2em}main{padding:1em 2em;line-height:1.7}"
    )


def layout(name: str = "spring") -> dict[str, object]:
    """The script's layout settings: spring starts from the circles of the communities and moves nodes by forces, circle stays there."""
    if name not in ("spring", "circle"):
        raise ValueError(f"unknown layout {name!r}; there are circle, spring")
    return {"name": name, "rounds": 300 if name == "spring" else 0, "length": 90, "push": 6000}


SCRIPT = r"""
const data = JSON.parse(document.getElementById('elements').textContent), set = JSON.parse(document.getElementById('layout').textContent);
const svg = document.querySelector('main svg'), info = document.querySelector('aside'), by = new Map(data.nodes.map(n => [n.id, n]));
const ask = id => document.getElementById(id), make = (tag, parent, attrs) => { const x = document.createElementNS('http://www.w3.org/2000/svg', tag); for (const k in attrs) x.setAttribute(k, attrs[k]); parent.appendChild(x); return x; };
const edges = (data.edges || []).filter(e => by.has(e.source) && by.has(e.target)), near = new Map(data.nodes.map(n => [n.id, new Set([n.id])]));
for (const e of edges) { near.get(e.source).add(e.target); near.get(e.target).add(e.source); }
const hue = n => `hsl(${(n.community * 137.5) % 360} 55% 55%)`, size = n => 5 + 3 * Math.sqrt(n.degree);
function place() {
  const groups = new Map();
  for (const n of data.nodes) { if (!groups.has(n.community)) groups.set(n.community, []); groups.get(n.community).push(n); }
  let k = 0;
  for (const part of groups.values()) { const a = 2 * Math.PI * k++ / groups.size, far = groups.size > 1 ? 120 + 25 * groups.size : 0, r = Math.max(40, part.length * 12);
    part.forEach((n, i) => { n.x = far * Math.cos(a) + r * Math.cos(2 * Math.PI * i / part.length); n.y = far * Math.sin(a) + r * Math.sin(2 * Math.PI * i / part.length); }); }
  const rounds = data.nodes.length > 800 ? Math.min(set.rounds, 30) : set.rounds;
  for (let t = 0; t < rounds; t++) { const heat = 1 - t / rounds;
    for (const n of data.nodes) { n.fx = -n.x * .02; n.fy = -n.y * .02; }
    data.nodes.forEach((a, i) => { for (let j = i + 1; j < data.nodes.length; j++) { const b = data.nodes[j], dx = a.x - b.x || .1, dy = a.y - b.y || .1, f = set.push / (dx * dx + dy * dy + 50) / 10; a.fx += dx * f / 10; a.fy += dy * f / 10; b.fx -= dx * f / 10; b.fy -= dy * f / 10; } });
    for (const e of edges) { const a = by.get(e.source), b = by.get(e.target), dx = b.x - a.x, dy = b.y - a.y, d = Math.hypot(dx, dy) || 1, f = (d - set.length) / d * .05; a.fx += dx * f; a.fy += dy * f; b.fx -= dx * f; b.fy -= dy * f; }
    for (const n of data.nodes) { const d = Math.hypot(n.fx, n.fy) || 1, step = Math.min(d, 20 * heat); n.x += n.fx / d * step; n.y += n.fy / d * step; } }
}
let view;
function fit() { const xs = data.nodes.map(n => n.x), ys = data.nodes.map(n => n.y), x = Math.min(...xs, 0) - 60, y = Math.min(...ys, 0) - 60; view = [x, y, Math.max(...xs, 0) - x + 120, Math.max(...ys, 0) - y + 60]; look(); }
const look = () => svg.setAttribute('viewBox', view.join(' '));
function draw() {
  svg.textContent = ''; const tip = make('marker', make('defs', svg, {}), { id: 'tip', viewBox: '0 0 8 8', refX: 8, refY: 4, markerWidth: 7, markerHeight: 7, orient: 'auto' }); make('path', tip, { d: 'M0 0L8 4L0 8z', fill: '#8894a0' });
  for (const e of edges) { const a = by.get(e.source), b = by.get(e.target), d = Math.hypot(b.x - a.x, b.y - a.y) || 1, r = size(b) / d;
    e.el = e.source === e.target ? make('path', svg, { d: `M${a.x} ${a.y}c-25 -40 25 -40 0 0` }) : make('path', svg, { d: `M${a.x} ${a.y}L${b.x - (b.x - a.x) * r} ${b.y - (b.y - a.y) * r}`, 'marker-end': 'url(#tip)' });
    e.el.classList.add('e', e.edge_class); make('title', e.el, {}).textContent = `${e.source} ${e.label} ${e.target} (${e.inference || ''})`;
    e.text = make('text', svg, { x: (a.x + b.x) / 2, y: (a.y + b.y) / 2, 'text-anchor': 'middle' }); e.text.textContent = ask('labels').checked ? e.label : ''; }
  for (const n of data.nodes) { n.el = make('circle', svg, { cx: n.x, cy: n.y, r: size(n), fill: hue(n) }); n.el.onclick = () => focus(n); make('title', n.el, {}).textContent = n.full_label;
    n.text = make('text', svg, { x: n.x, y: n.y - size(n) - 3, 'text-anchor': 'middle' }); n.text.textContent = n.show_label || data.nodes.length < 40 ? n.label : ''; }
  show();
}
let only = null;
function show(path) {
  const word = ask('search').value.trim().toLowerCase(), kind = ask('origin').value, hit = n => (!word || n.id.toLowerCase().includes(word)) && (!kind || n.origin === kind) && (!only || only.has(n.id));
  const on = new Set(); for (const n of data.nodes) if (hit(n)) { on.add(n.id); if (word) near.get(n.id).forEach(x => on.add(x)); }
  const lit = x => path ? path.includes(x) : on.has(x);
  for (const n of data.nodes) for (const x of [n.el, n.text]) x.classList.toggle('dim', !lit(n.id));
  for (const e of edges) { const here = lit(e.source) && lit(e.target); for (const x of [e.el, e.text]) x.classList.toggle('dim', !here); e.el.classList.toggle('path', !!path && here && path.indexOf(e.target) === path.indexOf(e.source) + 1); }
}
function focus(n) { only = near.get(n.id); ask('from').value = ask('from').value || n.id; if (ask('from').value !== n.id) ask('to').value = n.id;
  info.textContent = `${n.full_label}: degree ${n.degree}, ${n.origin}, community ${n.community}. ` + edges.filter(e => e.source === n.id || e.target === n.id).map(e => `(${e.source}) --[${e.label}]--> (${e.target})`).join('; '); show(); }
function route() { const from = ask('from').value, to = ask('to').value, back = new Map([[from, null]]); let row = by.has(from) && by.has(to) && from !== to ? [from] : [];
  while (row.length && !back.has(to)) { const next = []; for (const e of edges) if (row.includes(e.source) && !back.has(e.target)) { back.set(e.target, e.source); next.push(e.target); } row = next; }
  if (from === to || !back.has(to)) { info.textContent = 'No path found'; return; }
  const path = []; for (let x = to; x !== null; x = back.get(x)) path.unshift(x); info.textContent = `${path.length - 1} hops: ${path.join(' > ')}`; show(path); }
for (const n of data.nodes) { const o = document.createElement('option'); o.value = n.id; ask('names').appendChild(o); }
ask('search').oninput = ask('origin').onchange = () => { only = null; show(); }; ask('labels').checked = edges.length <= set.most_labels; ask('labels').onchange = draw; ask('go').onclick = route; ask('fit').onclick = fit;
ask('all').onclick = () => { only = null; for (const x of ['search', 'from', 'to', 'origin']) ask(x).value = ''; info.textContent = ''; show(); };
ask('theme').onclick = () => document.documentElement.classList.toggle('other'); ask('layout-name').onchange = x => { set.rounds = x.target.value === 'spring' ? 300 : 0; place(); draw(); fit(); };
ask('save').onclick = () => { const a = document.createElement('a'); a.href = URL.createObjectURL(new Blob([JSON.stringify(data, null, 2)], { type: 'application/json' })); a.download = 'graph.json'; a.click(); };
svg.onwheel = x => { x.preventDefault(); const f = x.deltaY > 0 ? 1.15 : 1 / 1.15; view = [view[0] + view[2] * (1 - f) / 2, view[1] + view[3] * (1 - f) / 2, view[2] * f, view[3] * f]; look(); };
svg.onmousemove = x => { if (x.buttons) { view[0] -= x.movementX * view[2] / svg.clientWidth; view[1] -= x.movementY * view[3] / svg.clientHeight; look(); } };
document.onkeydown = x => { if (x.target.tagName !== 'INPUT') ({ f: fit, t: ask('theme').onclick, Escape: ask('all').onclick, '/': () => { x.preventDefault(); ask('search').focus(); } }[x.key] || (() => 0))(); };
place(); draw(); fit();
"""

_CONTROLS = (
    '<input id="search" placeholder="Search (/)"><select id="origin"><option value="">all origins</option><option>extracted</option><option>augmented</option><option>both</option></select>'
    '<input id="from" list="names" placeholder="from"><input id="to" list="names" placeholder="to"><datalist id="names"></datalist><button id="go">Path</button>'
    '<select id="layout-name"><option{spring}>spring</option><option{circle}>circle</option></select><label><input type="checkbox" id="labels">edge labels</label>'
    '<button id="fit">Fit (f)</button><button id="theme">Theme (t)</button><button id="save">Save</button><button id="all">All (Esc)</button>'
    '<span>extracted <svg style="width:30px;height:10px;display:inline"><line x1="0" y1="5" x2="30" y2="5"/></svg> augmented <svg style="width:30px;height:10px;display:inline"><line class="augmented" x1="0" y1="5" x2="30" y2="5"/></svg></span>'
)


def network_parts(dark: bool = False, name: str = "spring") -> tuple[str, str, str, str]:
    """What a network page has before its title, between the title and the heading, between the heading and the elements, and after them."""
    settings = json.dumps(layout(name) | {"most_labels": MOST_EDGE_LABELS})
    controls = _CONTROLS.format(**{x: " selected" if x == name else "" for x in ("spring", "circle")})
    return (
        '<!doctype html>\n<meta charset="utf-8">\n<title>',
        f"</title>\n<style>{stylesheet(dark)}</style>\n<header><h1>",
        f'</h1>{controls}</header>\n<main style="padding:0"><svg></svg></main><aside></aside>\n<script type="application/json" id="layout">{settings}</script>\n<script type="application/json" id="elements">',
        f"</script>\n<script>{SCRIPT}</script>\n",
    )


def text_head(title: str, entities: int, triples: int, dark: bool = False) -> str:
    return f'<!doctype html>\n<meta charset="utf-8">\n<title>{escape(title)}</title>\n<style>{stylesheet(dark)}</style>\n<header><h1>{escape(title)}</h1><span>{entities} entities</span><span>{triples} triples</span></header>\n'
