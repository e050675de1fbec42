"""Template table of the derived corpus: which document becomes which file.

Document ``doc_id`` belongs to repository ``doc_id div 40`` and template ``doc_id % 40``.
``active`` gives (modulus, residues) on the repository number. A ``text`` file carries the
whole document below its body. Besides, every document has a file with its whole text.
"""

from __future__ import annotations

KEY64 = "ab12cd34" * 8
ZERO64, ONE64, ZERO40 = "0" * 64, "11" * 32, "0" * 40
LOW40, MIX40 = "ab12" * 10, "Ab12" * 10
WORDS12 = "able " * 11 + "zoo"
ROWS49 = "\n    a = 1" * 49

ALL = (1, (0,))

# Where the whole text of a document lies, by ``doc_id % 5``: folders that all line rules read.
TEXT_PATHS = ("notes/text_{id}.txt", "lib/text_{id}.sh", "web/text_{id}.js", "src/text_{id}.go", "conf/text_{id}.toml")
TEXT_TID = 1000
# Second copies in skipped folders, and in a Python file as comments.
SECOND_PATHS = {1: "docs/text_{id}.md", 3: "src/text_{id}.py", 4: "build/text_{id}.js"}
SECOND_TID = 1010

# Small repositories, one for each document with ``doc_id % 10 = 7``; every second holds the text as well.
# path, content (the document's text where there is none), modulus
TIDY_TID = 2000
TIDY_FILES = ((".gitignore", ".env\n*.log\n__pycache__/", 10), ("pyproject.toml", '[project]\nname = "tidy"', 10), ("notes.txt", None, 20))

# (tid, path, active, kind, body)
TEMPLATES = (
    (0, ".gitignore", (3, (1,)), "raw", "*.log\n__pycache__/"),
    (1, ".gitignore", (3, (2,)), "raw", ".env"),
    (2, ".env", (2, (0,)), "raw", "TOKEN=abcdef"),
    (3, "requirements.txt", (4, (0, 1, 2)), "raw", "requests>=2.0\n# c\n\nflask==2.0\nnumpy\nfoo @ git+https://x/y\n-e ./lib\nflask==2.1\npytest==8.0"),
    (4, "package.json", (4, (1,)), "raw", '{"main": "index.js",\n "dependencies": {"a": "*", "b": "1.0.0"}}'),
    (5, "pyproject.toml", (4, (2,)), "raw", '[tool.x]\nbranch = "main"\nversion = "1.0"'),
    (6, "SKILL.md", (4, (1,)), "raw", "---\nname: a\ndescription: b\n---\nbody"),
    (7, "SKILL.md", (4, (3,)), "raw", "no header"),
    (8, "agents/openai.yaml", (8, (1, 7)), "raw", "interface: {}"),
    (9, "references/rules.md", (5, (1, 2, 3, 4)), "raw", "`eval(` is bad\nuse password now"),
    (10, "tests/test_a_{id}.py", ALL, "raw", "password = 'changeme'"),
    (11, "tests/old_suite_{id}.txt", ALL, "text", "plain"),
    (12, "docs/threshold_{id}.md", ALL, "text", "reviewed 2020-01-15"),
    (13, "pytest.ini", (2, (1,)), "raw", "[pytest]"),
    (14, "src/util_{id}.py.bak", ALL, "raw", "a = 1"),
    (15, "assets/app_{id}.min.js", ALL, "raw", "document.write(x)"),
    (16, "assets/logo_{id}.png", ALL, "raw", "binary"),
    (17, "build/gen_{id}.js", ALL, "raw", "document.write(t);\nlocalStorage.setItem('jwt', t);"),
    (18, "web/app_{id}.js", ALL, "text", "el.innerHTML = x;\nsessionStorage.setItem('auth_token', t);\nconsole.log('my token', t);\nfetch('http://a.example/b');\nel.addEventListener('x', f);\n// TODO fix"),
    (19, "web/clean_{id}.ts", ALL, "text", "el.addEventListener('x', f);\nel.removeEventListener('x', f);"),
    (20, "conf/app_{id}.yaml", ALL, "text", 'cors: "*"\napi_key: "abcdef123"\nverify=False\nallow_origins: ""\nconsole.log("changeme"); os.system(x)  # noqa: audit'),
    (21, "keys/a_{id}.txt", ALL, "raw", "-----BEGIN PRIVATE KEY-----\n-----BEGIN RSA PRIVATE KEY-----\n-----BEGIN RSA KEY-----"),
    (22, "wallet/w_{id}.js", ALL, "raw", f"m = '{WORDS12}'\nk = \"0x{KEY64}\"; j = '{ONE64}'\na = '0x{LOW40}'; b = '0x{ZERO40}'; c = '0x{MIX40}'"),
    (23, "src/quiet_{id}.js", ALL, "raw", "eval(x); # noqa: audit\nos.system(x)\ny = pickle.loads(b)"),
    (24, "infra/main_{id}.tf", ALL, "raw", "resource {}"),
    (25, ".github/ci_{id}.yml", ALL, "raw", "password: x"),
    (26, "data/x_{id}.csv", ALL, "raw", "a,b"),
    (27, "lib.egg-info/meta_{id}.txt", ALL, "raw", "password"),
    (28, "Dockerfile", ALL, "raw", "FROM x"),
    (29, "src/broken_{id}.py", ALL, "raw", "def f(:"),
    (30, "scripts/tool_{id}.py", (7, (1, 2, 3, 4, 5, 6)), "raw", 'import requests\ndef fetch(url: str) -> str:\n    """d"""\n    print(url)\n    price = float(url)\n    r = requests.get(url)\n    return requests.get(url, timeout=5)'),
    (31, "src/exc_{id}.py", ALL, "raw", "try:\n    a = 1\nexcept:\n    pass\ntry:\n    a = 2\nexcept (ValueError, Exception):\n    a = 3"),
    (32, "src/proc_{id}.py", ALL, "raw", 'import subprocess\nsubprocess.run("ls " + d)\nsubprocess.run(["ls"])\nsubprocess.Popen("{}".format(d), shell=True)\nopen(f"{d}/x")'),
    (33, "src/loop_{id}.py", ALL, "raw", "import json\nfor a in x:\n    for b in a:\n        json.loads(b)\n    def g():\n        json.loads(a)\nwith open(p) as f:\n    pass"),
    (34, "src/async_{id}.py", ALL, "raw", 'import time, requests, aiohttp\nasync def run(u: str) -> None:\n    """d"""\n    time.sleep(1)\n    requests.get(u, timeout=2)\n    s = aiohttp.ClientSession()'),
    (35, "src/fn_{id}.py", ALL, "raw", 'def f(data, *args, x=[], **kw):\n    temp = 42\n    MAX = 99\n    y = -7\n    return None\ndef _h():\n    pass\ndef e() -> None:\n    """d"""\n    return None'),
    (36, "src/nest_{id}.py", ALL, "raw", 'def n(a: int) -> int:\n    """d"""\n    if a:\n        return 1\n    elif a > 1:\n        return 1\n    elif a > 2:\n        return 1\n    elif a > 0:\n        return 2\n    return 0'),
    (37, "src/long_{id}.py", ALL, "raw", f'def l() -> None:\n    """d"""{ROWS49}'),
    (38, "src/key_{id}.py", ALL, "raw", f'acct = Account.from_key("0x" + k)\nacct = Account.from_key("{KEY64}")\nacct = Account.from_key("0x{ZERO64}")\n# TODO later'),
    (39, "README_{id}.md", ALL, "text", "TODO: write\nlorem ipsum"),
)

# Findings of the code rules per template, worked out by hand: (tid, rule, line, snippet).
# A repeated row is a finding that occurs twice.
CODE_FINDINGS = (
    (29, "python-parse-error", 1, None),
    (30, "python-print-call", 4, "calls print"),
    (30, "python-float-money", 5, "amount held as float"),
    (30, "python-http-no-timeout", 6, "request with no timeout"),
    (30, "python-magic-number", 2, "fetch numbers without a name: 5"),
    (31, "python-bare-except", 3, "catches without a type"),
    (31, "python-except-pass", 3, "handler only passes"),
    (31, "python-broad-except", 7, "catches every Exception"),
    (32, "subprocess-interpolated-command", 2, "subprocess.run"),
    (32, "subprocess-interpolated-command", 4, "subprocess.Popen"),
    (32, "path-interpolation-risk", 5, "open"),
    (32, "open-without-context-manager", 5, "open(...)"),
    (33, "expensive-call-in-loop", 4, "json.loads"),
    (33, "expensive-call-in-loop", 4, "json.loads"),
    (33, "python-missing-type-hints", 5, "g no type for: return"),
    (33, "python-public-function-no-docstring", 5, "g is undocumented"),
    (34, "python-async-blocking-call", 2, "run blocks on: requests.get, time.sleep"),
    (34, "aiohttp-session-without-context", 6, "aiohttp.ClientSession(...)"),
    (35, "python-missing-type-hints", 1, "f no type for: data, x, *args, **kw, return"),
    (35, "python-public-function-no-docstring", 1, "f is undocumented"),
    (35, "python-weak-name", 1, "f vague names: data, temp, x"),
    (35, "python-magic-number", 1, "f numbers without a name: 42"),
    (35, "python-mutable-default", 1, "f shares a default value"),
    (35, "python-empty-function", 6, "_h does nothing"),
    (35, "python-empty-function", 8, "e does nothing"),
    (36, "python-deep-nesting", 1, "n is nested to depth 4"),
    (37, "python-long-function", 1, "l is 51 lines long"),
    (38, "web3-inline-from-key", 2, "Account.from_key"),
    (38, "python-src-todo", 4, "# TODO later"),
)
# Files that the comment rule cannot tokenise: (tid, rule).
CODE_BLOCKED = ((29, "scan-error"),)

# --- Second corpus, for the checklist rules: 20 files per repository ------------------
CHECK_TEMPLATES = (
    (0, "requirements.txt", (3, (0, 1)), "raw", "Requests==2.0\nnumpy==1.0\nnumpy==1.1\npytest==8.0\nbig_lib==1.0\nPyYAML==6.0"),
    (1, ".gitignore", (2, (0,)), "raw", ".env\n*.log\n__pycache__\nvenv/"),
    (2, "docs/guide_{id}.md", ALL, "text", "updated 2020-01-15"),
    (3, "src/trade_{id}.py", (4, (0, 1, 2)), "raw", "import requests, aiohttp, asyncio, logging\nfrom utils import helper\nasync def go(urls, volume, n):\n    s = aiohttp.ClientSession()\n    await asyncio.gather(*urls)\n    for u in urls:\n        requests.get(u)\n    place_order(1)\n    return n / volume"),
    (4, "src/chain_{id}.py", (4, (0, 1, 2)), "raw", "def send(w3, tx):\n    n = w3.eth.get_transaction_count(a)\n    w3.eth.send_transaction(tx)\ndef safe(w3, tx):\n    with nonce_lock:\n        n = w3.eth.get_transaction_count(a)\n        g = w3.eth.estimate_gas(tx)\n        w3.eth.send_transaction(tx)\ngas_price = 20_000\nchain_id = 1\nbalance = 0"),
    (5, "src/api.py", ALL, "raw", 'def read(r):\n    return r.json()["a"]\ndef checked(r):\n    r.raise_for_status()\n    return r.json()\n@retry(3)\ndef place_item(x):\n    return x\n@tenacity.retry\ndef send_item(x, idempotency_key):\n    return x\nURL = "https://api.example/x?apikey=1"'),
    (6, "src/load_{id}.py", ALL, "raw", 'import pickle, yaml\na = pickle.load(f)\nb = yaml.load(f)\nc = yaml.load(f, Loader=yaml.SafeLoader)\nd = yaml.load(f, Loader=yaml.Loader)\ncur.execute("INSERT INTO t VALUES (1)")\nwith conn:\n    cur.execute("insert into t values (2)")\nx = 1  # type: ignore\ny = 2  # type: ignore[attr] kept for old callers'),
    (7, "src/exc_{id}.py", ALL, "raw", 'try:\n    a = 1\nexcept Exception:\n    a = 2\ntry:\n    a = 1\nexcept Exception as e:\n    logger.error(e)\n    raise\n# a = 1\n# b = 2\n# c = 3\n# d = 4\n# TEMP fix\nif price == target_price:\n    pass\nz = round(amount, 2)\nSTART = "2020-01-01"\nDEBUG = True\nraise NotImplementedError'),
    (8, "tests/test_exc_{id}.py", ALL, "raw", "try:\n    a = 1\nexcept Exception:\n    a = 2\nSTART = '2020-01-01'"),
    (9, "pkg_{id}/__init__.py", ALL, "raw", "\n"),
    (10, "full/__init__.py", ALL, "raw", ""),
    (11, "full/mod.py", (2, (0,)), "raw", "import numpy\nx = 1"),
    (12, "scripts/run_me.py", ALL, "raw", "import loguru\nfrom full import mod\nfrom api import checked\nprint(1)"),
    (13, "docs/usage.md", (3, (0,)), "raw", "call run_me to start"),
    (14, "src/old_{id}.pyc", ALL, "raw", "x"),
    (15, "notes_{id}.tmp", ALL, "raw", "x"),
    (16, "src/retry_{id}.py", (4, (0, 1)), "raw", "@retry(3)\ndef place_order(x):\n    return x\n@tenacity.retry\ndef send_order(x, idempotency_key):\n    return x"),
    (17, "src/dup_{id}.js", ALL, "raw", "function a() {\n  one();\n\n  two();\n  three();\n}\nfunction a() {\none();\ntwo();\nthree();\n}"),
    (18, "README_{id}.md", ALL, "text", "hello"),
    (19, "conf/settings_{id}.yaml", ALL, "text", "DEBUG = True\nurl: https://h.example/?token=abc"),
)

# Findings of the checklist rules on code facts: (tid, rule, line, snippet).
CHECK_CODE_FINDINGS = (
    (3, "client-session-no-timeout", 4, "aiohttp.ClientSession"),
    (3, "gather-no-return-exceptions", 5, "asyncio.gather"),
    (3, "order-without-slippage-cap", 8, "place_order"),
    (3, "no-rate-limit", 3, "go"),
    (3, "unguarded-division", 3, "go"),
    (4, "send-without-gas-estimate", 1, "send"),
    (4, "nonce-without-lock", 1, "send"),
    (5, "json-without-status-check", 1, "read"),
    (6, "unsafe-deserialization", 2, "pickle.load"),
    (6, "unsafe-deserialization", 3, "yaml.load"),
    (6, "unsafe-deserialization", 5, "yaml.load"),
    (6, "sql-write-outside-with", 6, "cur.execute"),
    (6, "type-ignore-no-reason", 9, "# type: ignore"),
    (7, "broad-except-silent", 3, ""),
    (16, "retry-without-idempotency", 2, "place_order"),
)
# Imports per template: (tid, line, module, names).
CHECK_IMPORTS = (
    (3, 1, "requests"),
    (3, 1, "aiohttp"),
    (3, 1, "asyncio"),
    (3, 1, "logging"),
    (3, 2, "utils"),
    (6, 1, "pickle"),
    (6, 1, "yaml"),
    (11, 1, "numpy"),
    (12, 1, "loguru"),
    (12, 2, "full"),
    (12, 3, "api"),
)
