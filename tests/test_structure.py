from seamline.operators import callgraph as cg
from seamline.operators.chunkers import chunk_files, chunk_go, chunk_python, chunk_terraform, chunk_yaml, refine, split_text, whole

GO = '''package main

import "fmt"

const (
	A = 1
	B = "{"
)

var (
	x = map[string]int{
		"}": 1,
	}
)

/* not a doc */

type (
	// T is documented
	T struct{ a, b int }
	I interface {
		M() interface{}
	}
)

// Doc one
// Doc two
func Plain(a interface{}, f func(int) struct{}) (r interface{}) {
	s := `raw { string
`
	go other(s, '{')
	return fmt.Sprint(helper(a))
}

func (s *Stack[T]) Push(v T) { s.grow(); defer func() { inner() }() }

func (t T) Value() []byte { return []byte(t.name()) }

func external(x int) int
type Last func(a int) error
'''


def spans(pieces):
    return [(p.symbol, p.start, p.end) for p in pieces]


def test_go_chunks():
    made = chunk_go(GO)
    assert spans(made) == [("", 5, 8), ("", 10, 14), ("T", 20, 20), ("I", 21, 23), ("Plain", 26, 33), ("Push", 35, 35), ("Value", 37, 37), ("external", 39, 39), ("Last", 40, 40)]
    assert made[2].content == "// T is documented\n\tT struct{ a, b int }" and made[4].content.startswith("// Doc one") and made[8].content == "Last func(a int) error"
    for broken in ("package x\nfunc {", "no go", "package a\nvar s = \"\n", "package p\n"):
        assert chunk_go(broken) == whole(broken)


def test_go_graph():
    nodes, edges = cg.graph_go(GO)
    assert nodes == [("Plain", 28, 33), ("Push", 35, 35), ("(T).Value", 37, 37), ("external", 39, 39)]
    assert edges == [("Plain", "other"), ("Plain", "Sprint"), ("Plain", "helper"), ("Push", "grow"), ("Push", "inner"), ("(T).Value", "name")]
    assert cg.graph_of("a.go", "package main\n\nfunc (s *S) M() {}\n") == ([("(*S).M", 3, 3)], [])


PY = "import os\nimport os\n\n# note\nasync def fetch():\n    return 1\n\n@cached\n@traced(1)\ndef outer():\n    def inner():\n        pass\n    return inner\n\nX = (1,\n  2)\n"


def test_python_chunks():
    made = chunk_python(PY)
    assert spans(made) == [("", 1, 4), ("fetch", 5, 6), ("outer", 8, 13), ("", 14, 17)]
    assert made[0].content == "import os\n# note" and made[2].content.startswith("@cached\n@traced(1)\ndef outer") and made[3].content == "X = (1,\n  2)"
    assert chunk_python("") == []
    assert spans(chunk_python("def a():\n  x = (\n\ndef b(:\n  y\nz\n")) == [("a", 1, 2), ("b", 4, 5), ("", 6, 7)]


def test_python_graph():
    text = "class Service:\n    def execute(self):\n        self.log_message(print(len('a')))\n        other.run()\n\n    @deco(1)\n    def log_message(self):\n        helper()\n\ndef main():\n    Service().execute()\nouter()\n"
    nodes, edges = cg.graph_python(text)
    assert nodes == [("Service", 1, 8), ("Service.execute", 2, 4), ("Service.log_message", 7, 8), ("main", 10, 11)]
    assert sorted(edges) == sorted([("Service.execute", "Service.log_message"), ("Service.execute", "run"), ("Service.log_message", "helper"), ("main", "execute"), ("main", "Service")])
    assert cg.graph_of("x.py", "def (") == ([], [])


TF = 'locals { a = 1 }\n# free\nresource "aws_vpc" "main" {\n  x = "}{"\n}\nresource "aws_route" "r" {\n  vpc = aws_vpc.main.id\n  m = module.net.out\n}\nmodule "net" {\n'


def test_terraform():
    assert spans(chunk_terraform(TF)) == [("", 1, 1), ("", 3, 5), ("", 6, 9)]
    assert chunk_terraform("nothing") == whole("nothing")
    nodes, edges = cg.graph_terraform(TF)
    assert nodes == [("resource.aws_vpc.main", 3, 5), ("resource.aws_route.r", 6, 9), ("module.net", 10, 11)]
    assert edges == [("resource.aws_route.r", "resource.aws_vpc.main"), ("resource.aws_route.r", "module.net")]


def test_yaml():
    text = "a: 1\nb: 2\n---\n\n---\nc: 3\n"
    assert spans(chunk_yaml(text)) == [("", 1, 2), ("", 6, 7)]
    assert [p.start for p in chunk_yaml(text, compat=True)] == [1, 8]
    assert chunk_yaml(" \n") == whole(" \n") and spans(chunk_yaml("a\r\n---\r\nb")) == [("", 1, 1), ("", 3, 3)]
    nodes, edges = cg.graph_yaml("jobs:\n- name: 'Build'\n  needs: [A, B]\n  id: \"two\"\n  uses: x\nname:\n")
    assert nodes == [("step.Build", 2, 3), ("step.two", 4, 7)] and edges == [("step.Build", "step.A"), ("step.Build", "step.B"), ("step.two", "step.x")]


def test_terraform_syntax():
    text = 'variable "one" {}\nresource "aws_a" "x" {\n  s = "}}} ${aws_b.y.id} and $${aws_no.z} and a_b.c" # aws_c.d {\n  t = "${lookup(module.m["k"].out, "}")}"\n  h = <<-EOT\n    { aws_d.e ${aws_e.f[0].id}\n  EOT\n  /* { aws_g.h */\n  n { p = aws_i.j[count.index].k }\n}\nx = 1\noutput "o" { value = var.one }\nlocals {\n  a = { b = 1 }\n}'
    nodes, edges = cg.graph_terraform(text)
    assert nodes == [("variable.one", 1, 1), ("resource.aws_a.x", 2, 10), ("output.o", 12, 12)]
    assert [b for _, b in edges] == ["resource.aws_b.y", "module.m", "resource.aws_e.f", "resource.aws_i.j"]
    assert spans(chunk_terraform(text)) == [("", 1, 1), ("", 2, 10), ("", 12, 12), ("", 13, 15)]
    for odd in ("", "{", "}", '"', "<<E", 'resource "a" {', "}" * 50 + "locals {\n}", 'a = "${"', "locals { x = <<E\n"):
        assert chunk_terraform(odd) and cg.graph_of("x.tf", odd)[1] == []


def test_terraform_across_files(spark):
    files = [("vpc.tf", '\nmodule "vpc" {\n  source = "./modules/vpc"\n}\n\nresource "aws_vpc" "main" {\n  cidr_block = "10.0.0.0/16"\n}\n'), ("net.tf", '\nresource "aws_route_table" "route_a" {\n  vpc_id   = aws_vpc.main.id\n  route_id = module.vpc.route_table_id\n}\n')]
    g = cg.extract_graph(spark.createDataFrame(files, "path string, text string"))
    report = cg.call_report(cg.nodes_of(g), cg.edges_of(g), "aws_route_table.route_a", "callee", 2).collect()
    assert {r.name for r in report} == {"resource.aws_vpc.main", "module.vpc"}


def test_yaml_steps_across_files(spark):
    files = [("ci.yaml", "\nsteps:\n  - name: Build\n    run_task: go build\n  - name: Test\n    needs: [Build]\n"), ("cd.yaml", "\nsteps:\n  - name: Deploy\n    needs:\n      - Test # first\n      - 'Build'\n    if: x\n")]
    g = cg.extract_graph(spark.createDataFrame(files, "path string, text string"))
    down = cg.call_report(cg.nodes_of(g), cg.edges_of(g), "step.Deploy", "callee", 3).collect()
    assert {(r.depth, r.name) for r in down} == {(1, "step.Test"), (1, "step.Build"), (2, "step.Build")}
    nodes, edges = cg.graph_yaml("- {name: a, needs: [b, 'c d']}\n- name: \"e\" # note\n  uses: org/act@v1\n  needs: []\n  needs:\n  - f\nid:\nname: # none\n")
    assert nodes == [("step.a", 1, 1), ("step.e", 2, 9)] and edges == [("step.a", "step.b"), ("step.a", "step.c d"), ("step.e", "step.org/act@v1"), ("step.e", "step.f")]


def test_refine():
    text = "\n".join(["aaaa", "bbbb", "c" * 30, "dd"])
    made = refine([whole(text)[0]._replace(start=10, end=13, symbol="s")], 12)
    assert [(p.symbol, p.start, p.end, p.content) for p in made] == [("", 10, 11, "aaaa\nbbbb"), ("", 12, 12, "c" * 30), ("", 13, 13, "dd")]
    assert split_text("a.bin", "x\n") == whole("x\n")


def test_chunk_files(spark, rows):
    df = spark.createDataFrame([("a.py", PY, 1), ("b.txt", "", 1), ("c.go", None, 1), (None, "x", 1)], "path string, text string, ord int")
    got = chunk_files(df).orderBy("path", "ord").collect()
    assert [(r.path, r.ord, r.symbol) for r in got] == [("a.py", 0, ""), ("a.py", 1, "fetch"), ("a.py", 2, "outer"), ("a.py", 3, ""), ("b.txt", 0, "")]
    assert chunk_files(df.limit(0)).count() == 0


def graph(spark):
    nodes = spark.createDataFrame([("A", "f", 1, 2), ("B", "f", 3, 4), ("C", "g", 1, 9), ("x.B", "h", 1, 1), ("MyB", "h", 2, 2)], "name string, file_path string, start_line int, end_line int")
    edges = spark.createDataFrame([("A", "B"), ("A", "B"), ("B", "C"), ("C", "A"), ("C", None), ("C", ""), ("A", "get_user")], "caller string, callee string")
    return nodes, edges


def test_resolution(spark, rows):
    nodes, edges = graph(spark)
    assert [r[0] for r in rows(cg.callees_of(edges, nodes, "A").select("name"))] == ["B", "MyB", "x.B"]
    assert [r[0] for r in rows(cg.callees_of(edges, nodes, "A", strict=True).select("name"))] == ["B", "x.B"]
    assert [r[0] for r in rows(cg.callers_of(edges, nodes, "x.B").select("name"))] == ["A"]
    assert cg.find_node(nodes, "B").first().name == "B" and cg.find_node(nodes.filter("name <> 'B'"), "B").first().name == "x.B" and cg.find_node(nodes, "q").count() == 0
    under = spark.createDataFrame([("getXuser", "f", 1, 1)], "name string, file_path string, start_line int, end_line int")
    assert cg.resolve(edges, under).count() == 0 and cg.resolve(edges.limit(0), nodes).count() == 0


def test_report(spark):
    nodes, edges = graph(spark)
    down = cg.call_report(nodes, edges, "A", "callee", 9, strict=True).collect()
    assert sorted((r.depth, ">".join(r.path)) for r in down) == [(1, "A>B"), (1, "A>x.B"), (2, "A>B>C"), (3, "A>B>C>A")]
    up = cg.call_report(nodes, edges, "C", "caller", 2, strict=True).collect()
    assert sorted((r.depth, ">".join(r.path)) for r in up) == [(1, "C>B"), (2, "C>B>A")]
    assert cg.call_report(nodes, edges, "C", "both", 1, strict=True).count() == 2
    assert cg.call_report(nodes, edges, "C", "sideways", 1).count() == 0 and cg.call_report(nodes, edges, "nobody", "both", 3).count() == 0


def test_replace(spark, rows):
    a = spark.createDataFrame([("f", "n1"), ("g", "n2")], "file_path string, name string")
    b = spark.createDataFrame([("f", "n3")], "file_path string, name string")
    assert rows(cg.replace_graph(a, b, b)) == [("f", "n3"), ("g", "n2")]
