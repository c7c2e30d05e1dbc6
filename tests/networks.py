"""The eight-variable chest clinic network. Its published tables."""

TABLES = [
    # variables (child first), values with the first variable slowest, False before True
    (("asia",), (0.99, 0.01)),
    (("tub", "asia"), (0.99, 0.95, 0.01, 0.05)),
    (("smoke",), (0.5, 0.5)),
    (("lung", "smoke"), (0.99, 0.9, 0.01, 0.1)),
    (("bronc", "smoke"), (0.7, 0.4, 0.3, 0.6)),
    (("either", "tub", "lung"), (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0)),
    (("xray", "either"), (0.95, 0.02, 0.05, 0.98)),
    (("dysp", "either", "bronc"), (0.9, 0.2, 0.3, 0.1, 0.1, 0.8, 0.7, 0.9)),
]
BOTH = (("both", "xray", "dysp"), (1.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0))

T, F = True, False
ASKED = [
    ({"tub": T}, {"asia": T}, 0.05),
    ({"either": T}, {"asia": T, "smoke": F, "bronc": T}, 0.0595),
    ({"either": T}, {"asia": T, "tub": T, "smoke": F, "bronc": T}, 1.0),
    ({"either": T}, {"asia": T, "tub": F, "smoke": F, "bronc": T}, 0.01),
    ({"dysp": F}, {"tub": T, "lung": T}, 0.18545454545),
    ({"xray": T, "dysp": T}, {"asia": T}, 0.09882267),
    ({"xray": T, "dysp": T}, {"bronc": F, "lung": T}, 0.686),
    ({"xray": T, "dysp": T}, {"bronc": F, "lung": T, "dysp": T}, 0.98),
    ({"xray": T, "dysp": T}, {"bronc": F, "lung": T, "xray": T}, 0.7),
    ({"xray": T, "dysp": T}, {"bronc": F, "lung": T, "xray": T, "dysp": T}, 1.0),
    ({"xray": T, "dysp": T}, {"bronc": F, "lung": T, "xray": T, "dysp": F}, 0.0),
]


def net_text():
    """The network as a file, parents first and the child fastest."""
    import itertools

    lines = ["-- a comment", "net { }"]
    for variables, _ in TABLES:
        lines.append(f'node {variables[0]} {{ states = ( "no" "yes" ); }}')
    for variables, values in TABLES:
        child, *parents = variables
        at = {a: v for a, v in zip(itertools.product((0, 1), repeat=len(variables)), values)}
        flat = " ".join(str(at[(c, *p)]) for p in itertools.product((0, 1), repeat=len(parents)) for c in (0, 1))
        head = f"{child} | {' '.join(parents)}" if parents else child
        lines.append(f"potential ( {head} ) {{ data = ( {flat} ) ; }}")
    return "\n".join(lines)


#: A weighted graph of nine vertices, (dst, cost) by source, listed both ways, and distances to vertex 0.
ROADS = {
    0: [(1, 4), (7, 8)],
    1: [(0, 4), (2, 8), (7, 11)],
    2: [(1, 8), (3, 7), (5, 4), (8, 2)],
    3: [(2, 7), (4, 9), (5, 14)],
    4: [(3, 9), (5, 10)],
    5: [(2, 4), (3, 14), (4, 10), (6, 2)],
    6: [(5, 2), (7, 1), (8, 6)],
    7: [(0, 8), (1, 11), (6, 1), (8, 7)],
    8: [(2, 2), (6, 6), (7, 7)],
}
DISTANCES = [0, 4, 12, 19, 21, 11, 9, 8, 14]
