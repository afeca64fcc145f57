"""Small sources of our own, with every shape of function and import; what they hold is in EXPECTED and IMPORTED."""

FILES = [
    (
        "shop/cart.ts",
        'import { rate } from "./rate";\nimport type { Item } from "../model/item";\nexport * from "react";\n\nexport function total(items: Item[], tax: number): number {\n  const priced = items.map((item) => item.price * tax);\n  return priced.reduce((sum, x) => {\n    return sum + x;\n  }, 0);\n}\n\nclass Cart {\n  private items: Item[] = [];\n  add(item: Item): void {\n    this.items.push(item);\n  }\n  static async load(id: string): Promise<Cart> {\n    if (id) {\n      return new Cart();\n    }\n    return fetchCart(id);\n  }\n}\n',
    ),
    (
        "shop/gen/walk.ts",
        'import "../side";\n// import { no } from "./commented";\nconst later = import("../late");\nconst old = require("./old");\nexport function* walk(\n  node: Node,\n  depth: number,\n): Generator<Node> {\n  yield node;\n}\nconst shout = function (word: string) {\n  return `${word.toUpperCase()}! }`;\n};\nconst handlers = {\n  open(path: string) {\n    return path;\n  },\n  close: () => 0,\n};\n',
    ),
    ("broken/half.ts", "function lost(: {\n}\n\nexport function found(coin: number): number {\n  return coin;\n}\n"),
    ("empty.ts", "const nothing = 1;\n"),
    (
        "wide/base.ts",
        "class Wide extends Base<" + ", ".join(f"Part{i}" for i in range(40)) + "> implements Shape<{ x: number; y: string }> {\n  area(): number {\n    return 1;\n  }\n}\nconst pick = <" + ", ".join(f"K{i} extends keyof Part{i}" for i in range(70)) + ">(k: K0) => k;\n",
    ),
    (
        "marks/braces.ts",
        "function quoted() {\n  const a = '}';\n  return a;\n}\nfunction ticked() {\n  return `}\n}`;\n}\nfunction joined() {\n  const b = 'x\\\n}';\n  return b;\n}\nfunction noted() {\n  // }\n  /* } */\n  if (noted) {\n    quoted();\n  }\n}\nexport const pump = async function* (n: number) {\n  yield n;\n};\nfunction outer() {\n  return (m: number) => m + 1;\n}\n",
    ),
    ("broken/open.ts", "export function first(a: number): number {\n  return a;\n}\n\nfunction torn(b: number) {\n  if (b) {\n    return b;\n\nexport function last(c: number): number {\n  return c;\n}\n"),
    ("node_modules/dep/index.ts", "export function hidden() {\n  return 1;\n}\n"),
    ("shop/notes.md", "function prose() {\n}\n"),
]

#: The sources among the files; the others aren't searched or are none.
SOURCES = [f for f in FILES if f[0].endswith(".ts") and not f[0].startswith("node_modules/")]

#: (path, seq, kind, start line, end line, error)
EXPECTED = [
    ("shop/cart.ts", 0, "function_declaration", 5, 10, False),
    ("shop/cart.ts", 1, "arrow_function", 6, 6, False),
    ("shop/cart.ts", 2, "arrow_function", 7, 9, False),
    ("shop/cart.ts", 3, "method_definition", 14, 16, False),
    ("shop/cart.ts", 4, "method_definition", 17, 22, False),
    ("shop/gen/walk.ts", 0, "generator_function_declaration", 5, 10, False),
    ("shop/gen/walk.ts", 1, "function_expression", 11, 13, False),
    ("shop/gen/walk.ts", 2, "method_definition", 15, 17, False),
    ("shop/gen/walk.ts", 3, "arrow_function", 18, 18, False),
    ("broken/half.ts", 0, "function_declaration", 1, 2, True),
    ("broken/half.ts", 1, "function_declaration", 4, 6, False),
    ("wide/base.ts", 0, "method_definition", 2, 4, False),
    ("wide/base.ts", 1, "arrow_function", 6, 6, False),
    ("marks/braces.ts", 0, "function_declaration", 1, 4, False),
    ("marks/braces.ts", 1, "function_declaration", 5, 8, False),
    ("marks/braces.ts", 2, "function_declaration", 9, 13, False),
    ("marks/braces.ts", 3, "function_declaration", 14, 20, False),
    ("marks/braces.ts", 4, "generator_function", 21, 23, False),
    ("marks/braces.ts", 5, "function_declaration", 24, 26, False),
    ("marks/braces.ts", 6, "arrow_function", 25, 25, False),
    ("broken/open.ts", 0, "function_declaration", 1, 3, False),
    ("broken/open.ts", 1, "function_declaration", 5, 7, True),
    ("broken/open.ts", 2, "function_declaration", 9, 11, False),
]

IMPORTED = [
    ("shop/cart.ts", 0, "./rate", "shop/rate"),
    ("shop/cart.ts", 1, "../model/item", "model/item"),
    ("shop/cart.ts", 2, "react", "react"),
    ("shop/gen/walk.ts", 0, "../side", "shop/side"),
    ("shop/gen/walk.ts", 1, "../late", "shop/late"),
]

SEEDS = [
    ("broken/half.ts", 4),
    ("broken/open.ts", 1),
    ("broken/open.ts", 5),
    ("broken/open.ts", 9),
    ("marks/braces.ts", 1),
    ("marks/braces.ts", 5),
    ("marks/braces.ts", 9),
    ("marks/braces.ts", 14),
    ("marks/braces.ts", 21),
    ("marks/braces.ts", 24),
    ("shop/cart.ts", 5),
    ("shop/cart.ts", 7),
    ("shop/cart.ts", 14),
    ("shop/cart.ts", 17),
    ("shop/gen/walk.ts", 11),
    ("shop/gen/walk.ts", 15),
    ("wide/base.ts", 2),
]

#: Locations to compare, and what comes of it: verdict, error, where, its cause, its text.
ASKED = [
    ("marks/braces.ts:2", "marks/braces.ts:6", "REVIEW", None, None, None, None),
    ("marks/braces.ts:2", "shop/cart.ts:18", "REVIEW", None, None, None, None),
    ("broken/half.ts:5", "broken/open.ts:2", "REVIEW", None, None, None, None),
    ("gone.ts:1", "gone/too.ts:1", None, "SourceUnreadable", "gone.ts:1", "SourceUnreadable", "the file can't be read: gone.ts"),
    ("shop/notes.md:1", "gone/too.ts:1", None, "SourceUnreadable", "shop/notes.md:1", "SourceUnreadable", "the file can't be read: shop/notes.md"),
    ("shop/cart.ts:6", "empty.ts:1", None, "ChunkingFailed", "empty.ts:1", "NoEnclosingFunction", "no function has this line"),
    ("shop/cart.ts:99", "empty.ts:1", None, "ChunkingFailed", "shop/cart.ts:99", "LineBeyondSource", "the source has only 23 lines"),
    ("broken/open.ts:6", "shop/cart.ts:6", None, "ChunkingFailed", "broken/open.ts:6", "UnparsableFunction", "the function from line 5 has a syntax error"),
    ("broken/half.ts:1", "shop/cart.ts:6", None, "ChunkingFailed", "broken/half.ts:1", "UnparsableFunction", "the function from line 1 has a syntax error"),
    ("shop/cart.ts", "shop/cart.ts:6", None, "MissingSeparator", "shop/cart.ts", "MissingSeparator", "a location is written file:line"),
    (":3", "shop/cart.ts:6", None, "EmptyPath", ":3", "EmptyPath", "the path is empty"),
    ("shop/cart.ts:six", "shop/cart.ts:6", None, "NotANumber", "shop/cart.ts:six", "NotANumber", "not a number: six"),
    ("shop/cart.ts:6", "shop/cart.ts:0", None, "Zero", "shop/cart.ts:0", "Zero", "lines count from 1"),
]
