"""Literal graphs of the tests: ``A>B`` is an edge, ``A>B:x`` one with a label or, if a number, a weight."""

from graphlake.graph import Graph


def graph(spark, edges: str, nodes: str = "", labels: dict | None = None, properties: dict | None = None) -> Graph:
    lines = []
    for x in edges.split():
        ends, _, tag = x.partition(":")
        s, d = ends.split(">")
        line = {"source": s, "target": d}
        if tag:
            try:
                line["weight"] = float(tag)
            except ValueError:
                line["label"] = tag
        lines.append(line)
    names = nodes.split() or sorted({n for e in lines for n in (e["source"], e["target"])})
    records = []
    for n in names:
        r = {"id": n}
        if labels is not None:
            r["label"] = labels.get(n, labels.get("*"))
        if properties is not None:
            r["properties"] = properties[n]
        records.append(r)
    return Graph.from_json(spark, records, lines)


ABC = "A B C D E F G H"
F1 = ("A>B B>C C>G A>D A>E E>F F>D", ABC)
F2 = ("A>B B>C A>C D>A D>E E>F F>D G>H H>G", ABC)
F3 = ("A>B B>C C>G A>D A>E E>F F>D D>G", "A B C D E F G")
F4 = ("A>B B>C C>G A>D A>E E>F F>D D>E", ABC)
F5 = ("A>B B>C A>C D>A D>E E>F", "A B C D E F G")
F7 = ("A>B:1 B>C:1 A>C:2 D>A:3 D>E:4 E>F:2 F>D:3", "A B C D E F G")
F8 = ("D>A D>B B>C C>B F>B F>E E>F E>D E>B K>E J>E I>E H>E G>E G>B H>B I>B", "A B C D E F G H I J K")


def cliques(sizes: list[tuple[int, int]]) -> str:
    return " ".join(f"{i}>{j}" for a, b in sizes for i in range(a, b) for j in range(i + 1, b))


F9 = (cliques([(0, 5), (5, 10), (10, 15)]).replace("5>6", "5>6:5").replace("13>14", "13>14:5") + " 0>0 0>0 0>0 0>5 5>10 10>0 10>0", " ".join(map(str, range(15))))
F14 = (
    "0>1:b 0>2:b 1>3:b 2>4:e 2>5:e 3>6:e 3>7:e 4>2:b 4>9:e 5>10:e 6>11:b 6>12:e 7>13:e 8>14:c 8>15:b 9>16:e 10>16:e 11>17:c 11>18:c 12>19:e 13>19:e",
    " ".join(map(str, range(20))),
)
F14_LABELS = {"0": "F", "1": "F", "14": "C", "15": "C", "17": "C", "18": "C", "*": "B"}
