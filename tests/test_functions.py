import pytest

from sluice.plans.lexer import QueryError

GOLDEN = {
    "0.1+1.4": "1.5",
    '"ab"+"cd"': "abcd",
    '5+"string"': "5string",
    "7-10": "-3",
    "6*7": "42",
    "1/8": "0.125",
    "1/3": "0.3333333",
    "2/3": "0.6666667",
    "10/5": "2",
    "1/0": None,
    "9%4": "1",
    '"1"+"2"': "3",
    'ltrim(" \t aabbccdd ")': "aabbccdd ",
    'ltrim(" zZaabcdzz "," zZ")': "aabcdzz ",
    'replace("Hello world","He","Ha")': "Hallo world",
    'substr("127.0.0.1:45",1,9)': "127.0.0.1",
    'if(1<2,"y","n")': ["y"],
    'if(mvappend("")=="",mvappend("tr","ue"),"f")': ["tr", "ue"],
    "round(1.545)": 2.0,
    "round(5.7432,3)": 5.743,
    "sigfig(1.00*1111)": "1110",
    'min("9","10","foo")': "10",
    'max("9","10","foo")': "foo",
    'min("10.0","4.7")': "4.7",
    'sum("foo",5,"2","x")': "7",
    'avg("foo",5,"1","bar")': 3,
    "tostring(true())": "true",
    'tostring(12345.6789,"commas")': "12,345.68",
    'tostring(255,"hex")': "0xFF",
    'tostring(90061,"duration")': "01:01:01",
    'tonumber("0A4",16)': 164,
    'tonumber("1.5")': None,
    'tonumber("zz",16)': None,
    'cidrmatch("192.168.2.5","192.168.2.0/24")': True,
    'cidrmatch("192.168.3.5","192.168.2.0/24")': False,
    'cidrmatch("2001:db8::1","2001:db8::/32")': True,
    'cidrmatch("10.0.0.1","2001:db8::/32")': False,
    'mvfind(mvappend("random","192.168.1.1"),"^\\d{1,3}\\.")': 1,
    'mvfind(mvappend("a"),"z")': None,
    'mvindex(split("mv1,mv2,mv3,mv4,mv5",","),2)': ["mv3"],
    'mvindex(split("mv1,mv2,mv3,mv4,mv5",","),2,3)': ["mv3", "mv4"],
    'mvindex(split("mv1,mv2,mv3,mv4,mv5",","),-1)': ["mv5"],
    'mvindex(split("a,b",","),5)': [],
    "mvrange(1,10,2)": ["1", "3", "5", "7", "9"],
    "mvrange(5,1)": [],
    'mvrange(1,172801,"1d")': ["1", "86401", "172801"],
    'mvzip(split("a,b,c",","),split("1,2",","))': ["a,1", "b,2"],
    'mvdedup(split("b,a,b",","))': ["b", "a"],
    'mvsort(split("b,a,c",","))': ["a", "b", "c"],
    'mvjoin(split("b,a",","),"-")': "b-a",
    'mvcount(split("b,a",","))': 2,
    'commands("search foo | stats count | sort count")': ["search", "stats", "sort"],
    "typeof(12)": "Number",
    'typeof("string")': "String",
    "typeof(1==2)": "Boolean",
    "typeof(null())": "Invalid",
    "isint(3)": True,
    "isnum(3.5)": True,
    "isstr(3)": False,
    'isstr("a")': True,
    "isbool(1==1)": True,
    "isnull(null())": True,
    "isnotnull(3)": True,
    'strptime("2018-08-13 11:22:33","%Y-%m-%d %H:%M:%S")': 1534159353,
    'strptime("no","%Y")': None,
    'strftime(1534188153,"%Y-%m-%d %T %I %p %Z")': "2018-08-13 19:22:33 07 PM UTC",
    'relative_time(1645092037,"-7d")': 1644487237,
    'relative_time(1645092037,"@d")': 1645056000,
    'spath("{\\"a\\":{\\"b\\":[1,2]}}","a.b[2]")': "2",
    'spath("<p><q>v</q></p>","p.q")': "v",
    'spath("nothing","p.q")': None,
    'json_valid("{\\"a\\":1}")': True,
    'json_valid("{a")': False,
    'urldecode("a%20b%2Fc")': "a b/c",
    'match("abc","b.")': True,
    'like("abc","a%")': True,
    'in("b","a","b")': True,
    'nullif("a","a")': None,
    "coalesce(null(),7)": 7,
    'case(1>2,"a",2>1,"b")': "b",
    'case(1>2,"a")': None,
    'validate(1<2,"first",2<1,"second")': "second",
    'md5("a")': "0cc175b9c0f1b6a831c399e269772661",
    "len(upper(\"abc\"))": 3,
    "pi()": 3.14159265358,
    'rtrim(lower("ABC  "))': "abc",
    'trim("xxaxx","x")': "a",
    'mvjoin(mvfilter(x!="b"),",")': None,
    "hypot(3,4)": 5.0,
    "pow(2,10)": 1024.0,
    "log(100)": 2.0,
    "log(8,2)": 3.0,
    "abs(0-5.5)": 5.5,
    "ceil(1.2)": 2,
    "floor(1.8)": 1,
    "exact(3)": 3,
}


def test_golden(spark):
    """All at once: each expression is a column."""
    from sluice.engine import Engine

    query = "| makeresults | eval " + ", ".join(f"v{i}={e}" for i, e in enumerate(GOLDEN))
    row = Engine(spark).run(query).first().asDict()
    wrong = {}
    for i, (e, want) in enumerate(GOLDEN.items()):
        got = row[f"v{i}"]
        if (abs(got - want) > 1e-9 if isinstance(want, float) and got is not None else got != want) or type(got) is not type(want):
            wrong[e] = (got, want)
    assert not wrong


def test_sigfig_over_a_column(run):
    got = [r["v"] for r in run("index=* | eval v=sigfig(offset/3.245), w=sigfig(offset*1.234), x=sigfig(offset-1.100) | sort num(offset) | fields v w x").collect()]
    assert got == ["0.3", "0.6", "0.9", "1", "2", "2", "2", "2", "3", "3.1"]
    row = run("index=* offset=10 | eval w=sigfig(offset*1.234), x=sigfig(offset-1.100)").first()
    assert row["w"] == "12" and row["x"] == "8.9"


@pytest.mark.parametrize("expression", ['"a"-1', '"a"*"b"', "nosuch(1)", "case(1)", "sigfig(5)", "len()"])
def test_errors(value, expression):
    with pytest.raises(QueryError):
        value(expression)


def test_text_column_arithmetic_fails_on_words(run):
    with pytest.raises(Exception, match="Eval arithmetics only allow Strings"):
        run("index=* | eval v=_raw-1").collect()


def test_text_columns_that_hold_numbers(run):
    rows = run('index=* | eval n=substr(_raw,5,2) | eval s=n+1, big=case(n>9,"y") | where n>=9 | sort num(offset) | fields s big').collect()
    assert [tuple(r) for r in rows] == [("10", None), ("11", "y")]


def test_mvfilter(run):
    assert run('index=* offset=1 | eval m=split("a,b,c",","), f=mvjoin(mvfilter(m!="b"),"") | fields f').first()["f"] == "ac"


def test_searchmatch_and_time(run):
    rows = run('index=* | eval m=searchmatch("offset<3 index=IDX_*"), t=relative_time(_time,"@d") | where m | fields offset t').collect()
    assert sorted(r["offset"] for r in rows) == [1, 2] and {r["t"] for r in rows} == {1672531200}


def test_exp_and_rounding_of_large_numbers(run, value):
    assert value("exp(153.3)") == 3.77871446208695e66 and value("exp(900)") == float("inf") and value("exp(null())") is None
    assert value("round(12345678901234567,2)") == 12345678901234567.0
    assert run('index=* offset=1 | eval m=split("0,1,2",","), f=mvjoin(mvfilter(exp(m)>2),",") | fields f').first()["f"] == "1,2"
