"""Whole scans over small trees."""

import pytest
from pyspark.sql import functions as F

from duskwatch import registry_from_rows, scan
from duskwatch.operators import rules as rules_module
from duskwatch.operators.findings import evidence_documents
from duskwatch.plans import scan as scan_module

NOW = "2026-06-06"


def evidence(result):
    rows = result.hits.orderBy("repo", "id", "file", "regex_ord", "line").collect()
    return [(r.id, r.file, r.line, r.text) for r in rows]


def finding(result, id_):
    return result.findings.filter(F.col("id") == id_).first()


DIRTY = {
    "src/agents.ts": 'import OpenAI from "openai";\n\nconst client = new OpenAI();\n\n// beta.assistants is going away\nconst a = client.beta.assistants.create();\n\nexport const cfg = {\n  model: "text-davinci-003",\n};\n',
    "src/esign.ts": 'export const signer = {\n  name: "x",\n  idCheckConfigurationName: "Phone Auth $",\n  phoneAuthentication: { recipMayProvideNumber: true },\n};\n',
    "src/gemini.ts": 'const ok = "gemini-2.5-flash-image-preview";\nconst m = "gemini-2.5-flash-image";\n',
    "src/key.ts": 'fetch(`https://api.example.com/x?hapikey=${k}`);\n',
}
CLEAN = {
    "src/llm.ts": '// text-davinci-003 and beta.assistants were used\n/* hapikey= */\nconst m = "gpt-5";\n',
    "src/Note.tsx": "export const N = () => <p>We used text-davinci-003 here, not beta assistants.</p>;\n{/* beta.threads */}\n",
    "app.py": "# openai.ChatCompletion.create()\nprint('hi')\n", "package.json": '{"dependencies": {"openai": "^4"}}',
}


def test_dirty_and_clean_trees(spark, tree, bundled):
    result = scan(tree({"dirty": DIRTY, "clean": CLEAN}), bundled, now=NOW)
    assert evidence(result) == [
        ("docusign-legacy-phone-auth", "src/esign.ts", 4, "phoneAuthentication:"),
        ("docusign-legacy-phone-auth", "src/esign.ts", 3, 'idCheckConfigurationName: "Phone Auth'),
        ("google-gemini-2-5-flash-image-shutdown", "src/gemini.ts", 2, '"gemini-2.5-flash-image"'),
        ("hubspot-api-key-hapikey", "src/key.ts", 1, "hapikey="),
        ("openai-assistants-api", "src/agents.ts", 6, "beta.assistants"),
        ("openai-legacy-retired-models", "src/agents.ts", 9, '"text-davinci-003"'),
    ]
    rows = {r.repo: r for r in result.summary.collect()}
    assert (rows["clean"].scanned_files, rows["clean"].detected, rows["clean"].verdict) == (3, 0, 0)
    assert (rows["dirty"].detected, rows["dirty"].high, rows["dirty"].verdict) == (5, 3, 1)
    nested = evidence_documents(result.hits).filter("id = 'docusign-legacy-phone-auth'").first()
    assert [m.line for m in nested.matches] == [4, 3]


def test_match_over_two_lines(spark, tree):
    registry = registry_from_rows(spark, [{
        "id": "fast", "vendor": "v", "title": "t", "severity": "low",
        "detect": {"patterns": [r'model:\s*"m-1",\s*speed:\s*"fast"']},
    }])
    result = scan(tree({"a.ts": 'call({\n  model: "m-1",\n  speed: "fast",\n});\n'}), registry, now=NOW)
    assert evidence(result) == [("fast", "a.ts", 2, 'model: "m-1", speed: "fast"')]


AI = {"id": "ai", "vendor": "v", "title": "t", "severity": "low", "applies_to": ["*"],
      "detect": {"sdk": ["ai"], "patterns": [r"\bCoreMessage\b", r"\bAgent\b"]}}
PY = {"id": "py", "vendor": "v", "title": "t", "severity": "low", "applies_to": ["py"],
      "detect": {"sdk": ["openai"], "patterns": [r"\bChatCompletion\b"]}}
OPEN = [
    'import { CoreMessage } from "ai";', 'import { Agent as Mine } from "ai"', 'import * as ai from "ai";\nai.Agent',
    'import D, { CoreMessage } from "ai";', 'const { CoreMessage } = require("ai");', 'import { Agent } from "ai/test";',
    'import type { CoreMessage } from "ai";', 'import { type CoreMessage } from "ai"', 'await import("ai"); CoreMessage',
    'import\n  { Agent }\n  from `ai`', 'export { Agent } from \'ai\'', 'import "ai"; Agent', 'require ( "ai" ); Agent',
]
SHUT = [
    "const m: CoreMessage = x;", 'import { x } from "aimee"; CoreMessage', 'import { x } from "ai-utils"; new Agent()',
    'import { foo } from "ai";\n// CoreMessage', "const cfg = { CoreMessage: 1 };", '// import "ai"\nCoreMessage',
    'import { x } from "AI"; Agent', 'import x, "ai\' Agent', 'important from "ai"; Agent', '_require("ai"); Agent',
]
PY_OPEN = ["import openai\nopenai.ChatCompletion", "from openai import ChatCompletion", "import os, openai.x as o\nChatCompletion",
           "  from openai.error import y\r\nChatCompletion", '"""\nimport openai\n"""\nChatCompletion']
PY_SHUT = ["ChatCompletion.create()", "from . import openai\nChatCompletion", "from .openai import x\nChatCompletion",
           "# import openai\nChatCompletion", "import openai_x\nChatCompletion", "x = 1; import openai\nChatCompletion"]


def test_import_gates(spark, tree):
    files = {f"open{n}.ts": code for n, code in enumerate(OPEN)} | {f"shut{n}.ts": c for n, c in enumerate(SHUT)}
    files |= {f"open{n}.py": c for n, c in enumerate(PY_OPEN)} | {f"shut{n}.py": c for n, c in enumerate(PY_SHUT)}
    result = scan(tree(files), registry_from_rows(spark, [AI, PY]), now=NOW)
    fired = {r.file for r in result.hits.select("file").distinct().collect()}
    assert fired == {name for name in files if name.startswith("open")}


def test_language_scope_and_ungated_languages(spark, tree):
    entry = {**PY, "applies_to": ["py", "go", "rb"]}
    files = {"a.tsx": 'import "openai"; ChatCompletion', "a.go": "ChatCompletion", "a.rb": "# ChatCompletion", "a.py": "ChatCompletion"}
    result = scan(tree(files), registry_from_rows(spark, [entry]), now=NOW)
    assert {r.file for r in result.hits.collect()} == {"a.go", "a.rb"}


MODEL = '"claude-sonnet-4-20250514"'


def test_mention_tier(spark, tree, bundled):
    use = f'import A from "@anthropic-ai/sdk";\nconst m = {MODEL};\n'
    copy = f"export const m = {MODEL};\n"
    result = scan(tree({
        "mention": {"src/pricing.tsx": copy}, "usage": {"src/llm.ts": use}, "mixed": {"a.tsx": copy, "b.ts": use},
        "python": {"app/llm.py": f"import anthropic\nm = {MODEL}\n"},
    }), bundled, now=NOW)
    got = {r.repo: (r.mention_only, r.effective_severity, r.trips_gate) for r in result.findings.collect()}
    assert got == {
        "mention": (True, "low", False), "usage": (False, "high", True), "mixed": (False, "high", True),
        "python": (False, "high", True),
    }
    flags = {r.file: r.mention for r in result.hits.filter("repo = 'mixed'").collect()}
    assert flags == {"a.tsx": True, "b.ts": False}
    assert {r.repo: r.verdict for r in result.summary.collect()}["mention"] == 0


def test_test_files_rank_down(spark, tree, bundled):
    use = "x.beta.assistants"
    result = scan(tree({"only": {"tests/a.ts": use}, "mixed": {"tests/a.ts": use, "src/b.ts": use}}), bundled, now=NOW)
    got = {r.repo: (r.test_only, r.severity, r.effective_severity) for r in result.findings.collect()}
    assert got == {"only": (True, "high", "low"), "mixed": (False, "high", "high")}


def test_suppression_and_ignore_file(spark, tree, bundled):
    text = 'a = "text-davinci-003" // dusk-ignore\n// dusk-ignore-next-line\nb = "text-davinci-003"\nc = "text-davinci-003"\n'
    result = scan(tree({"r": {"a.ts": text, "skip/b.ts": text, ".duskignore": "skip/\n"}}), bundled, now=NOW)
    assert evidence(result) == [("openai-legacy-retired-models", "a.ts", 4, '"text-davinci-003"')]
    assert result.summary.first().scanned_files == 1


def test_manifest_findings_and_presence_is_no_usage(spark, tree, bundled):
    result = scan(tree({
        "r": {"package.json": '{"dependencies": {"aws-sdk": "^2.1", "vue": "^3.1", "openai": "1"}}',
              "go.mod": "require github.com/dgrijalva/jwt-go v3\n", "requirements.txt": "aws-sdk==1\n"},
        "old": {"package.json": '{"dependencies": {"vue": "^2.7"}}'}, "odd": {"package.json": '{"dependencies": {"vue": "latest"}}'},
    }), bundled, now=NOW)
    assert {(r.repo, r.id) for r in result.findings.collect()} == {
        ("r", "aws-sdk-js-v2-eol"), ("r", "go-dgrijalva-jwt-unmaintained"), ("old", "vue-2-eol"),
    }
    assert {r.repo: r.verdict for r in result.summary.collect()} == {"r": 0, "old": 0, "odd": 2}


def test_other_routes_give_the_same(spark, tree, bundled, monkeypatch, tmp_path):
    """Many packs, ignore rules beyond a broadcast and stored tables change nothing."""
    files = tree({"dirty": {**DIRTY, ".duskignore": "gemini.ts"}, "clean": CLEAN, "other": DIRTY})
    plain = scan(files, bundled, now=NOW)
    want = (sorted(plain.hits.collect()), sorted(plain.summary.collect()))
    monkeypatch.setattr(rules_module, "PACK_ROWS", 40)
    monkeypatch.setattr(scan_module, "fits_broadcast", lambda df: False)
    other = scan(files, bundled, now=NOW, store=str(tmp_path / "s"))
    assert len(other.rules.packs) > 2
    assert (sorted(other.hits.collect()), sorted(other.summary.collect())) == want


def test_entries_without_optional_parts(spark, tree):
    rows = [{"id": "p", "vendor": "v", "title": "t", "severity": "low", "detect": {"patterns": ["abc"]}},
            {"id": "m", "vendor": "v", "title": "t", "severity": "low", "detect": {"models": ["abc"]}}]
    result = scan(tree({"a.js": '"abc"'}), registry_from_rows(spark, rows), now=NOW)
    assert {(r.id, r.text) for r in result.hits.collect()} == {("p", "abc"), ("m", '"abc"')}


@pytest.mark.parametrize("include, count", [(False, 0), (True, 2)])
def test_dependency_directories(spark, tree, bundled, include, count):
    files = {"node_modules/x/a.ts": "beta.assistants", ".venv/b.py": "y = 'text-davinci-003'"}
    assert scan(tree(files), bundled, now=NOW, include_deps=include).hits.count() == count
