"""Symbols, references, routes, components and edges of source text, with the expected results written out."""

from archgraph.sources import csharp, edges, extract

CS = '''using System;
namespace Depot.Web;
/// <summary>Crates of a depot.</summary>
[ApiController]
[Route("v1/[controller]")]
public class CratesController : ControllerBase, ICrates
{
    private readonly IShelf _shelf, _spare;
    public const int Limit = 9;
    public string Label { get; set; } = "x { y";
    public int Half => Limit / 2;
    public CratesController(IShelf shelf) { _shelf = shelf; }
    [HttpGet("{id}")]
    [Authorize]
    public async Task<ActionResult<CrateDto>> Find(int id, Query q = null)
    {
        var c = new CrateDto(id); // Ghost()
        return Ok(Pack(c));
    }
    [HttpPost] public CrateDto Add(CrateDto c) => Pack(c);
    CrateDto Pack(CrateDto c) { Weight w = null; return c; }
}
public record CrateDto(int Id);
public interface ICrates { CrateDto Pack(CrateDto c); }
public enum Size { S, L }
public delegate void Packed(int id);
'''


def test_csharp_symbols():
    got = {(r[2], r[3], r[8], r[10], r[11]) for r in csharp.csharp_symbols("a.cs", CS)}
    c = "Depot.Web.CratesController"
    assert got == {
        (c, "class", None, True, False), (c + "._shelf", "variable", "IShelf", False, False), (c + "._spare", "variable", "IShelf", False, False), (c + ".Limit", "constant", "int", True, False),
        (c + ".Label", "variable", "string", True, False), (c + ".Half", "variable", "int", True, False), (c + "..ctor", "function", None, True, False), (c + ".Find", "function", "Task<ActionResult<CrateDto>>", True, True),
        (c + ".Add", "function", "CrateDto", True, False), (c + ".Pack", "function", "CrateDto", False, False), ("Depot.Web.CrateDto", "class", None, True, False), ("Depot.Web.ICrates", "interface", None, True, False),
        ("Depot.Web.ICrates.Pack", "function", "CrateDto", False, False), ("Depot.Web.Size", "enum", None, True, False), ("Depot.Web.Packed", "type", "void", True, False),
    }
    first = csharp.csharp_symbols("a.cs", CS)[0]
    assert (first[1], first[5], first[6], first[9]) == ("CratesController", 6, 22, "Crates of a depot.")
    assert csharp.csharp_symbols("a.cs", "") == [] and csharp.csharp_symbols("a.cs", "class { (((") == []


def test_csharp_references():
    got = {(r[0].split(".")[-1].split("#")[0], r[1], r[2]) for r in csharp.csharp_references("a.cs", CS)}
    assert {("CratesController", "ControllerBase", "extends"), ("CratesController", "ICrates", "implements"), ("CratesController", "IShelf", "uses_type"), ("Find", "Pack", "calls"), ("Find", "CrateDto", "uses_type"), ("Find", "Query", "uses_type"), ("Add", "Pack", "calls"), ("Pack", "Weight", "uses_type")} <= got
    assert not {r[1] for r in got} & {"Ghost", "new", "return"} and ("Pack", "Pack", "calls") not in got


def test_csharp_routes():
    got = [(r[0], r[1], r[3], r[5]) for r in csharp.csharp_routes("a.cs", CS)]
    assert got == [("/v1/crates/{id}", ["GET"], True, "CrateDto"), ("/v1/crates", ["POST"], False, "CrateDto")]
    mapped = 'var g = app.MapGroup("/v2/bins");\ng.MapGet("/{id}", (int id) => new BinDto(id)).RequireAuthorization();\napp.MapPost("/bare/", List<BinDto> (BinDto b) => Keep(b));\n'
    assert [(r[0], r[1], r[3], r[5]) for r in csharp.csharp_routes("p.cs", mapped)] == [("/v2/bins/{id}", ["GET"], True, "BinDto"), ("/bare", ["POST"], False, "BinDto")]


TS = '''"use client";
import Root, { Form as Fm, useLoad } from "./kit/forms";
import React, { useContext } from "react";
export const Mood = createContext(null);
export class Card extends Root implements Fm, Side {
  private width: number = 1;
  async fill(n: Fm): Promise<number> {
    return weigh(n);
  }
}
interface Side { a: string }
function weigh(x: Fm) { return 1; }
export function Board({ a }: BoardProps) {
  const t = useContext(Mood); const [v, set] = useState<number>(0);
  useLoad();
  return <Mood.Provider value={t}><Tile a={a} /></Mood.Provider>;
}
interface BoardProps { a: string }
const Tile = (p: BoardProps) => <div>Don't</div>;
'''
KIT = "export default class Root {}\nexport interface Form { a: string }\nexport function useLoad() { return 1; }\n"


def test_typescript_members_and_components():
    got = {(r[2], r[3], r[5], r[6], r[10]) for r in extract.typescript_symbols("src/card.tsx", TS)}
    assert {("Card", "class", 5, 10, True), ("Card.width", "variable", 6, 6, False), ("Card.fill", "function", 7, 9, True), ("Board", "component", 13, 17, True), ("Mood", "context", 4, 4, True), ("Tile", "component", 19, 19, False)} <= got
    parts = {r[0].split("::")[1]: r[1:7] for r in edges.typescript_components("src/card.tsx", TS)}
    assert parts == {"Board#component": (True, False, True, ["Mood"], ["Mood"], "BoardProps"), "Tile#component": (True, False, False, [], [], "BoardProps")}
    ng = "@Component({ selector: 'app-x', imports: [A, B] })\nexport class XView { n = signal(0); }\n"
    assert edges.typescript_components("x.ts", ng) == [("x.ts::XView#component", True, False, True, [], [], "selector: app-x | imports: A, B", "x.ts")]
    assert edges.typescript_components("x.tsx", "export const A = () => <b/>;", True)[0][1] and not edges.typescript_components("x.tsx", "export const A = () => <b/>;")[0][1]


def test_typescript_edges(spark):
    files = spark.createDataFrame([("src/card.tsx", TS), ("src/kit/forms.ts", KIT), (None, TS), ("src/none.ts", None)], "path string, content string")
    got = {(r["source"].split("::")[1], r["target"].split("::")[1], r["kind"]) for r in edges.edges(edges.references(files, "typescript"), extract.symbols(files, "typescript")).collect()}
    assert {x for x in got if x[2] != "imports"} == {
        ("Card#class", "Root#class", "extends"), ("Card#class", "Root#class", "uses_type"), ("Card#class", "Form#interface", "implements"), ("Card#class", "Form#interface", "uses_type"), ("Card#class", "Side#interface", "implements"), ("Card#class", "Side#interface", "uses_type"),
        ("Card.fill#function", "weigh#function", "calls"), ("weigh#function", "Form#interface", "uses_type"), ("Board#component", "useLoad#hook", "calls"), ("Board#component", "Mood#context", "consumes_context"), ("Board#component", "Mood#context", "provides_context"),
        ("Board#component", "Tile#component", "renders"), ("Board#component", "BoardProps#interface", "uses_type"), ("Tile#component", "BoardProps#interface", "uses_type"),
    }
    assert len([x for x in got if x[2] == "imports"]) == 7 * 3


GO = '''package depot
const (
    Low = 1
    high = 2
)
type Base struct { }
type Depot struct {
    Base
    *Yard
    shelf Shelf
}
type Yard struct {
}
type Shelf interface {
    Take(id string) Crate
}
type Crate struct {
}
func (d *Depot) Load(c Crate) error {
    var s Shelf
    return lift(c)
}
func lift(c Crate) error { return nil }
'''


def test_go_edges(spark):
    assert {r[2]: (r[3], r[10]) for r in extract.go_symbols("a.go", GO)}["high"] == ("constant", False)
    files = spark.createDataFrame([("a.go", GO)], "path string, content string")
    got = {(r["source"].split("::")[1], r["target"].split("::")[1], r["kind"]) for r in edges.edges(edges.references(files, "go"), extract.symbols(files, "go")).collect()}
    assert got == {
        ("Depot#class", "Base#class", "extends"), ("Depot#class", "Yard#class", "extends"), ("Depot#class", "Shelf#interface", "uses_type"), ("Shelf#interface", "Crate#class", "uses_type"),
        ("Depot.Load#function", "Crate#class", "uses_type"), ("Depot.Load#function", "Shelf#interface", "uses_type"), ("Depot.Load#function", "lift#function", "calls"), ("lift#function", "Crate#class", "uses_type"),
    }


def test_csharp_and_python_edges(spark):
    files = spark.createDataFrame([("a.cs", CS)], "path string, content string")
    got = {(r["source"].split(".")[-1], r["target"].split(".")[-1], r["kind"]) for r in edges.edges(edges.references(files, "csharp"), extract.symbols(files, "csharp")).collect()}
    assert {("CratesController#class", "ICrates#interface", "implements"), ("Find#function", "Pack#function", "calls"), ("Add#function", "CrateDto#class", "uses_type")} <= got
    py = spark.createDataFrame([("a.py", "class A:\n    def f(self, x: B): return g(x)\nclass B(A): pass\ndef g(x): return 1\n")], "path string, content string")
    got = {(r["source"].split("::")[1], r["target"].split("::")[1], r["kind"]) for r in edges.edges(edges.references(py, "python"), extract.symbols(py, "python")).collect()}
    assert got == {("A.f#function", "B#class", "uses_type"), ("A.f#function", "g#function", "calls"), ("B#class", "A#class", "extends")}
    assert edges.edges(edges.references(py.limit(0), "go"), extract.symbols(py.limit(0), "go")).count() == 0
