"""Text blocks from which the ``part`` table is rendered as source files, one file per part.

``{w}`` becomes a word of the part's name plus the block's position, ``{n}`` a number from its
size and ``{p}`` its key. Blocks of script files are balanced, so any sequence of them is a file.
"""

SCRIPT = (
    "import { {w}Tool, helper{n} } from './f{next}';\nimport * as path{p} from 'path';\nimport {w}Lib from '../lib/f{next}';\n{w}Tool(helper{n});",
    "export function load{w}(a, b, c, d, e, f) {\n  if (a == b && c != d) {\n    return eval(a + '{n}');\n  }\n  for (const x of b) {\n    for (const y of x) {\n      total{n} += y.filter(z => z > {n});\n    }\n  }\n  return total{n};\n}",
    "const api_key_{w} = \"abcdef{n}{p}abcdef\";\nvar old{w} = {n};\nlet unused{w}{p} = path;\n_quiet{n} = old{w};",
    "async function fetch{w}() {\n  try {\n    fetchData{n}('/api/{w}');\n    const r = await fetch('/x');\n    while (r.next) {\n      await r.step({n});\n    }\n  } catch (err) {\n  }\n}",
    "// TODO: revisit {w} {n}\n/* HACK block */ console.log('{w}', {n});\nconsole.error('failed {w}');\n// FIXME later // XXX\ndebugger;\nconst note{n} = 'debugger inside {w}';\n// HACK: {w} {n}\nx(); // xxx later",
    "/** Documented {w} */\nexport class Box{w} {\n  public async run{w}(input) {\n    if (input) {\n      if (input.a) {\n        for (const k in input.a) {\n          if (k) {\n            while (input.b) {\n              if (input.c || k && input.d) { input.c = k ? {n} : 1; }\n            }\n          }\n        }\n      }\n    }\n    return input;\n  }\n}",
    "export const View{w} = (props) => {\n  const [s{n}, setS] = useState();\n  if (props.ready) {\n    useEffect(() => {\n      setS({n});\n    });\n  }\n  useEffect(() => {\n    props.items.sort.cache = s{n};\n  }, []);\n  return props.items.map(item => <li onClick={() => setS(item)}>{item}</li>);\n};",
    "function query{w}(db, id) {\n  db.query(`select * from {w} where id = ${id}`);\n  db.execute(\"delete from {w} where id = \" + id);\n  el.innerHTML = id;\n  fs.readFileSync('{w}.txt');\n  return new Function('return {n}');\n  cleanup{n}();\n}",
    "interface Shape{w} { area: any; }\nfunction cast{w}(v: any, list: Array<any>) {\n  // @ts-ignore\n  const t = v as any;\n  return t!.area + list!.length;\n}",
    "function many{w}(v) {\n  switch (v) {\n    case 1: return a1();\n    case 2: return a2();\n    case 3: return a3();\n    case 4: return a4();\n    case 5: return a5();\n  }\n  if (v > {n} || v < 7 && v !== 9) { go(); } else if (v) { stop(); }\n  return v ? v : (v ?? 4321);\n}",
    "new Promise(async (resolve) => {\n  sendEmail('{w}');\n  this.mailer.saveAsync({n});\n  api.get().then(r => r).catch(e => e);\n  api.put().then(r => r).catch(e => e);\n  api.del().then(r => r).catch(e => e);\n});",
    "const limit{w} = 4096;\nconst ratio = compute(3.75, 98765);\nscale(3.75, 98765, {n}77);\nconst url = 'https://example.com/{w}/a/very/long/path/that/goes/on/and/on/until/it/passes/the/limit/of/one/hundred/and/twenty/characters';\nconst wide = first{w} + second{w} + third{w} + fourth{w} + fifth{w} + sixth{w} + seventh{w} + eighth{w} + ninth{w} + tenth{w};",
    "function long{w}(rows) {\n" + "".join(f"  step{i}(rows, {{n}});\n" for i in range(54)) + "}",
    "const broken{w} = () => {\n  try { go(); } catch (e) { /* ignored */ }\n  if (/[^=!<>]==[^=]/.test(line)) { flag('{w}'); }\n  if (line == {n}) return 1;\n  let html = '<p>' == x;\n};",
)
SQL = (
    "SELECT * FROM {w} JOIN b ON b.id = {n} JOIN c ON c.id = b.id\nORDER BY id;",
    "UPDATE {w} SET x = {n};",
    "DELETE FROM {w}\n  WHERE id = {n};\nselect a from {w}\norder by a\nlimit 10;",
    "CREATE TABLE {w}{n} (\n  id int references p(id) on delete cascade,\n  k int references q(id) ON UPDATE SET NULL\n);",
    "EXECUTE IMMEDIATE 'drop {w}';\nexec (@sql);\nselect x from y order by x\n  offset {n};",
    "DELETE FROM tail{n};",
)
YAML = (
    "{w}:\n\tkey: {n}\n   odd: true",
    "{w}:\n  flag: yes\n  quoted: \"no\"\n  name: v{n}",
    "list{n}:\n  - a\n - b\n  on: off",
)
JSON = (
    "{\"name\": \"{w}\", \"size\": {n}}",
    "{\"list\": [1, 2,], \"size\": {n}}",
    "{\"a\": {\"b\": [{n}, null, true]}, \"c\": \"{w}\"} trailing",
    "[{\"k\": \"{w}\"},\n {\"k\": {n} }\n]",
    "{'single': {n}}",
)
SHELL = (
    "#!/bin/bash\necho $name{w}\nrm -rf \"$dir\"",
    "cat file{n} | grep {w}\neval $cmd",
    "for f in $list; do\n  cp $f '/tmp/{w}'\ndone\necho $x\"",
)
DOCKER = (
    "FROM node:latest\nRUN apt-get install curl\nCOPY . .",
    "# base {w}\nFROM alpine:{n}\nRUN apt-get install -y git\nUSER root",
    "RUN apt-get install --assume-yes vim\n  USER app\nRUN apt-get install",
)
MARKDOWN = (
    "# {w}\nSee [part](#{w}) and [gone](#missing-{n}).",
    "## Setup\n[top](#setup) [site](https://example.com/{w}#x) [none](#)",
    "Plain {w} text with [a](#b{n}) link.",
)
PYTHON = (
    "def load_{w}(items=[], opts={}):\n    try:\n        return items[{n}]\n    except:\n        return 12345",
    "def find_{w}(db, user_id):\n    x = 12345 + 2.5\n    return db.query(User).filter(User.id == user_id).first()",
    "cursor.execute(\"select * from {w} where id = \" + user_id)\npassword = 'hunter2{w}{n}xyz'",
)
JAVA = (
    "class A{w} {\n  void run() {\n    for (int i = 0; i < {n}; i++) {\n      for (int j = 0; j < 7; j++) {\n        for (int k = 0; k < 5; k++) { go(); }\n      }\n    }\n  }\n}",
    "class B{n} {\n  int f() { try { return 777; } catch (Exception e) { } return 777; }\n}",
)

# (extension, blocks, blocks per file); the file of part p uses entry p % 16.
FILE_KINDS = (
    ("ts", SCRIPT, 5), ("tsx", SCRIPT, 5), ("js", SCRIPT, 5), ("jsx", SCRIPT, 5),
    ("ts", SCRIPT, 4), ("tsx", SCRIPT, 6), ("mjs", SCRIPT, 3), ("py", PYTHON, 4),
    ("sql", SQL, 4), ("yaml", YAML, 3), ("json", JSON, 1), ("sh", SHELL, 3),
    ("Dockerfile", DOCKER, 3), ("md", MARKDOWN, 4), ("java", JAVA, 2), ("vue", SCRIPT, 2),
)
FOLDERS = ("src/app", "daemon/services", "scripts", "lib", "src/components", "pkg/services")
