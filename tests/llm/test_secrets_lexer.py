"""The lexer against programs whose bindings are known, and against syntax that it has to tell apart."""

import random

import pytest

from grainfield.llm.secrets import literals, scan

VALUE = "Xk29fjQ81mZ"


def found(text):
    return [text[a:b] for a, k, b in scan(text) if k == 3]


@pytest.mark.parametrize(
    "text",
    [
        "db_passphrase = x\nx = '{}'\n", 'a = b\nb = c\nc = "{}"\nauth_key = a', 'auth = """{}"""', "auth = \'\'\'{}\'\'\'", '# db_pwd = "{}"\n', '/* pwd = "{}" */', '<!-- pwd="{}" -->',
        'db_pwd =\n   "{}"', 'db_pwd = \\\n "{}"', 'setPassphrase("{}")', 'conn = connect(user="a", pwd="{}")', 'props.put("db.pwd", "{}")', 'pwd = os.getenv("DB_PWD_NAME1", "{}")',
        'conf["pwd"] = "{}"', 's = "Server=a;Pwd={};User=b"', '<add key="db_pwd" value="{}"/>', 'pwd: Optional[str] = "{}"', "it's the dogs' pwd: '{}' don't", 'db_pwd = "{}"  # old: "abcd1234efgh"',
        '{{"auth": {{"salt": "{}"}}}}', 'client_pwd += "{}"', 'pwd = b"{}".encode()', "- pwd: {}\n", "http://a.b/c?auth={}&x=1", "pwd := `{}`", "# a: b\n  # db_pwd: {}\n", 'def f(pwd="{}"): pass', "export DB_PWD={} cmd",
    ],
)
def test_forms(text):
    assert found(text.format(VALUE)) == [VALUE]


@pytest.mark.parametrize("text", ["db_pwd = self.config.password", 'pwd = getenv("DB_PWD_NAME1")', 'if pwd == "Xk29fjQ81mZ": pass', 'db_pwd = ""', 'pwd = ""\'x\'""', "public_key_path = '/etc/keys/a1B2c3d4.pub'", 'x = "Xk29fjQ81mZ"', 'name = "token Xk29fjQ81mZ"'])
def test_no_secret(text):
    assert found(text) == []


def test_a_comment_binds_nothing_outside():
    assert found('x = "aaBB11cc22"\n# x = "zzYY99xx88"\ndb_pwd = x\n') == ["aaBB11cc22"]


def test_no_empty_spans():
    for text in ('auth = """kJ8s-92Lq_0zPd"""', 'auth = ""', 'auth = "" + "kJ8s-92Lq_0zPd"', "auth = \'\'\'\'\'\'"):
        assert all(a < b for a, _, b in scan(text))


def test_every_operand_and_every_constant():
    parts = [f"q{i}Zk{i * 7}xW" for i in range(60)]
    assert found("signing_key = " + " + ".join(f'"{p}"' for p in parts[:14])) == parts[:14]
    names = "".join(f'c{i} = "{p}"\n' for i, p in enumerate(parts))
    assert found("auth_key = " + " + ".join(f"c{i}" for i in range(60)) + "\n" + names) == parts


def test_long_input_takes_time_in_proportion():
    import time

    for unit in ("/*", "# # ", '"', "f(", " pwd=f(", "a = a + a\n", "pwd: ", "pwd : a b ", "pwd=bb1bbbbbb ", "pwd=\n\n\n", "pwd='"):
        text = unit * (120_000 // len(unit)) + "\npwd = a"
        began = time.thread_time()
        literals(text)
        assert time.thread_time() - began < 10, unit


@pytest.mark.parametrize("seed", range(40))
def test_generated_programs(seed):
    """Bindings in random order, kept as a table beside the text: a slow search over the table says what has to be found."""
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(12)] + ["dbPwd", "auth_key", "client_secret_value", "salt", "label"]
    table, lines = [], []
    for k in range(rng.randint(5, 60)):
        target = rng.choice(names)
        operands = [rng.choice(names) if rng.random() < 0.5 else f"Zq{k}x{i}Lm7{rng.randint(100, 999)}" for i in range(rng.randint(1, 4))]
        shown = [o if o in names else rng.choice(["'{}'", '"{}"', "`{}`"]).format(o) for o in operands]
        lines.append(rng.choice(["{} = {}", "let {} = {};", "{} := {}", "  {}: {}"]).format(target, rng.choice([" + ", "+", " + "]).join(shown)) + rng.choice(["", "  # note", "  // x = 'AbC123dEf456'"]))
        table.append((target, operands))

    def means(i, name):
        before = [j for j in range(i) if table[j][0] == name]
        after = [j for j in range(i + 1, len(table)) if table[j][0] == name]
        return before[-1] if before else after[0] if after else None

    want = set()
    for i, (target, _) in enumerate(table):
        if target in ("dbPwd", "auth_key", "client_secret_value", "salt"):
            todo, seen = [i], set()
            while todo:
                j = todo.pop()
                if j is None or j in seen:
                    continue
                seen.add(j)
                for o in table[j][1]:
                    if o in names:
                        todo.append(means(j, o))
                    else:
                        want.add(o)
    assert set(found("\n".join(lines))) == want
