"""A graph of 24 quads with golden results."""

EX = "http://example.org/"
RDF, RDFS = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>", "<http://www.w3.org/2000/01/rdf-schema#label>"


def ex(name):
    return f"<{EX}{name}>"


A1 = "_:a1"
INT42 = '"42"^^<http://www.w3.org/2001/XMLSchema#integer>'
QUADS = [
    (ex("alice"), RDF, ex("Person"), ""),
    (ex("alice"), RDFS, '"Alice"@en', ""),
    (ex("alice"), RDFS, '"Alicia"@de', ""),
    (ex("alice"), ex("knows"), ex("bob"), ""),
    (ex("alice"), ex("address"), A1, ""),
    (A1, ex("street"), '"10 Freestyle Road"', ""),
    (ex("bob"), RDF, ex("Person"), ""),
    (ex("bob"), RDFS, '"bob"', ""),
    (ex("bob"), ex("team"), ex("red"), ""),
    (ex("carol"), RDF, ex("Person"), ""),
    (ex("carol"), RDFS, '"2 Carol"@fr', ""),
    (ex("carol"), ex("team"), ex("blue"), ""),
    (ex("red"), RDF, ex("Team"), ""),
    (ex("red"), RDFS, '"Red swimmers"@en', ""),
    (ex("red"), ex("partOf"), ex("league"), ""),
    (ex("blue"), RDF, ex("Team"), ""),
    (ex("blue"), ex("partOf"), ex("league"), ""),
    (ex("league"), RDF, ex("League"), ""),
    (ex("league"), RDFS, '"10 League"@en', ""),
    (ex("dave"), RDF, ex("Person"), ""),
    (ex("dave"), ex("age"), INT42, ""),
    (ex("dave"), ex("note"), '"café"', ""),
    (ex("alice"), ex("knows"), ex("bob"), ex("g1")),
    (ex("erin"), RDF, ex("Person"), ex("g1")),
]
NOISE = ["# a comment", "", f"{ex('x')} {ex('p')} {ex('o')} .\r", f"{ex('x')} {ex('p')}", f'"lit" {ex("p")} {ex("o")} .', f"{ex('x')}\t{ex('p')}\t{ex('o')} ."]


def trig():
    lines = [f"{s} {p} {o.replace('é', chr(92) + 'u00E9')} ." for s, p, o, g in QUADS if not g]
    lines += NOISE + [f"{ex('g1')} {{"] + [f"{s} {p} {o} ." for s, p, o, g in QUADS if g] + ["}"]
    return "\n".join(lines) + "\n"
