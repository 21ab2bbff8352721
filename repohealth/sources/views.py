"""Adapter views: the supplied tables shaped as repository facts.

Each text is written in the SQL subset Spark and DuckDB share, with the inputs
as ``{name}`` placeholders, so one text serves the jobs and their oracles.
All views are row-wise (a filter and a projection) unless noted, so they stay
one scan stage and are pruned by Catalyst to the columns a job reads.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from repohealth.functions.scalars import computed_once

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

# ---------------------------------------------------------------- scan history
VIEWS["v_scans"] = """
SELECT o_orderkey AS scan_id, o_custkey AS repo_id, o_orderdate AS created_at,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  CAST(o_orderkey % 101 AS INT) AS overall_score,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'evaluating' WHEN '2-HIGH' THEN NULL ELSE 'maintaining' END AS mode
FROM {orders}"""

VIEWS["v_repos"] = """
SELECT c_custkey AS repo_id, c_name AS name,
  concat('/srv/repos/', lower(c_mktsegment), '-', CAST(c_nationkey AS STRING), '/', CAST(c_custkey AS STRING)) AS path,
  c_acctbal >= 0 AS active, CAST(c_custkey % 97 AS INT) AS stars,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 365 END AS days_since_commit,
  concat('{{"stargazers_count":', CAST(c_custkey % 900 AS STRING), ',"forks_count":', CAST(c_nationkey AS STRING), ',"open_issues_count":', CAST(c_custkey % 7 AS STRING),
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat(',"language":"', lower(c_mktsegment), '"') END,
    ',"topics":["cli","', lower(c_mktsegment), '"],"mode":"',
    CASE WHEN c_custkey % 4 = 0 THEN 'evaluating' ELSE 'maintaining' END, '"}}') AS metadata
FROM {customer}"""

VIEWS["v_module_results"] = """
SELECT l_orderkey AS scan_id, concat('mod', CAST(l_suppkey % 4 AS STRING)) AS module_id,
  CAST(max(l_quantity) * 2 AS INT) AS score, 1 - max(l_discount) AS confidence,
  CASE max(l_returnflag) WHEN 'A' THEN 'not_applicable' ELSE 'completed' END AS state
FROM {lineitem} GROUP BY l_orderkey, concat('mod', CAST(l_suppkey % 4 AS STRING))"""

# The same results with module names of the catalogue, mixed states and a score of -1.
VIEWS["v_named_results"] = """
SELECT scan_id,
  CASE module_id WHEN 'mod0' THEN 'security' WHEN 'mod1' THEN 'dependencies' WHEN 'mod2' THEN 'git-health' ELSE 'complexity' END AS module_id,
  CASE WHEN scan_id % 11 = 0 THEN -1 ELSE score END AS score, confidence,
  CASE WHEN scan_id % 13 = 0 THEN 'unavailable' WHEN scan_id % 17 = 0 THEN 'skipped'
       WHEN scan_id % 19 = 0 THEN NULL ELSE state END AS state,
  CASE WHEN scan_id % 23 = 0 THEN 'not json'
       ELSE concat('{{"total":', CAST(score AS STRING), ',"high":', CAST(scan_id % 7 AS STRING), '}}') END AS metrics
FROM {v_module_results}"""

VIEWS["v_findings"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS finding_id,
  l_orderkey AS scan_id, concat('mod', CAST(l_suppkey % 4 AS STRING)) AS module_id,
  CASE l_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity,
  concat('dir', CAST(l_partkey % 3 AS STRING), '/f', CAST(l_partkey % 6 AS STRING), '.ts') AS file_path,
  l_linenumber * 10 AS line, concat('cat', CAST(l_partkey % 2 AS STRING)) AS category,
  concat('issue ', CAST(l_partkey % 3 AS STRING)) AS message, 1 - l_discount AS confidence
FROM {lineitem}"""

# Findings with catalogue names, missing paths, suggestions, statuses and numbers inside messages.
VIEWS["v_rich_findings"] = """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS finding_id,
  l_orderkey AS scan_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'security' WHEN 1 THEN 'dependencies' WHEN 2 THEN 'git-health' ELSE 'complexity' END AS module_id,
  CASE l_partkey % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' ELSE 'odd' END AS severity,
  CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN ''
       ELSE concat(CASE l_partkey % 4 WHEN 0 THEN 'lib/db' WHEN 1 THEN 'app/api/x' WHEN 2 THEN 'components' ELSE 'src/core' END, '/f', CAST(l_partkey % 40 AS STRING), '.ts') END AS file_path,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_linenumber * 10 END AS line,
  CASE l_partkey % 9 WHEN 0 THEN 'security' WHEN 1 THEN 'any-usage' WHEN 2 THEN 'dependency' WHEN 3 THEN 'complexity' WHEN 4 THEN 'dead-code' WHEN 5 THEN 'churn' WHEN 6 THEN 'todo-age' WHEN 7 THEN 'circular' ELSE 'naming' END AS category,
  CASE l_partkey % 6
    WHEN 0 THEN concat('Function f has cyclomatic complexity ', CAST(l_partkey % 60 AS STRING), ' (threshold: 10)')
    WHEN 1 THEN concat('File has ', CAST(l_partkey AS STRING), ' lines of code')
    WHEN 2 THEN concat('High churn: ', CAST(l_partkey % 90 AS STRING), ' commits (author: dev', CAST(l_suppkey % 7 AS STRING), ')')
    WHEN 3 THEN concat('Circular dependency: a', CAST(l_partkey % 50 AS STRING), '.ts -> b', CAST(l_suppkey % 20 AS STRING), '.ts -> c', CAST(l_linenumber AS STRING), '.ts')
    WHEN 4 THEN concat('module imports lib', CAST(l_partkey % 30 AS STRING))
    ELSE concat('pkg', CAST(l_partkey AS STRING), ' is outdated') END AS message,
  CASE WHEN l_suppkey % 5 = 0 THEN concat('Run `fix ', CAST(l_partkey % 8 AS STRING), '` and then `npm test`')
       WHEN l_suppkey % 5 = 1 THEN '' WHEN l_suppkey % 5 = 2 THEN 'Split the file' ELSE NULL END AS suggestion,
  CASE l_linenumber % 4 WHEN 0 THEN 'new' WHEN 1 THEN 'recurring' WHEN 2 THEN 'fixed' ELSE 'regressed' END AS status,
  1 - l_discount AS confidence
FROM {lineitem}"""

VIEWS["v_snapshots"] = """
SELECT o_custkey AS repo_id, o_orderkey AS snapshot_id, o_orderdate AS ts,
  CAST(floor(o_totalprice) AS BIGINT) % 1000 / 10 AS overall
FROM {orders}"""

VIEWS["v_audits"] = """
SELECT o_orderkey AS audit_id, o_custkey AS repo_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' ELSE 'gamma' END AS provider,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_orderdate AS created_at, CAST(floor(o_totalprice) AS BIGINT) AS tokens_in, o_orderkey % 5000 AS tokens_out,
  CASE WHEN o_orderkey % 9 = 0 THEN 'broken'
       ELSE concat('[{{"severity":"high","file":"a', CAST(o_orderkey % 5 AS STRING), '.ts","line":3,"message":"m1","category":"c"}}',
         CASE WHEN o_orderkey % 2 = 0 THEN ',{{"severity":"low","file":"b.ts","message":"m2","category":"d"}}' ELSE '' END, ']') END AS findings
FROM {orders}"""

VIEWS["v_audit_findings"] = """
SELECT l_returnflag AS provider, concat('mod', CAST(l_suppkey % 4 AS STRING)) AS module_id,
  concat('./Dir', CAST(l_partkey % 7 AS STRING), '/F', CAST(l_partkey % 40 AS STRING), '.ts') AS file,
  concat('Cat ', CAST(l_partkey % 4 AS STRING)) AS category, l_linenumber AS line
FROM {lineitem}"""

# Findings of two independent sides of the same repository, for the similarity join.
VIEWS["v_scan_side"] = """
SELECT l_suppkey AS repo_id,
  concat(CASE l_partkey % 3 WHEN 0 THEN 'src/' WHEN 1 THEN 'lib/deep/' ELSE '' END, 'File', CAST(l_partkey % 25 AS STRING), '.ts') AS file_path,
  CASE WHEN l_partkey % 8 = 0 THEN NULL ELSE l_linenumber * 4 END AS line,
  concat('unused variable value', CAST(l_partkey % 6 AS STRING), CASE l_linenumber % 2 WHEN 0 THEN ' inside loop' ELSE '' END) AS message,
  CASE l_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' ELSE 'low' END AS severity
FROM {lineitem} WHERE l_returnflag = 'N'"""

VIEWS["v_audit_side"] = """
SELECT l_suppkey AS repo_id,
  concat(CASE l_partkey % 2 WHEN 0 THEN 'src/' ELSE '' END, 'file', CAST(l_partkey % 25 AS STRING), '.ts') AS file_path,
  CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE l_linenumber * 4 + l_partkey % 3 END AS line,
  concat('loop uses variable value', CAST(l_partkey % 4 AS STRING)) AS message,
  CASE l_linenumber % 2 WHEN 0 THEN 'HIGH' ELSE 'low' END AS severity
FROM {lineitem} WHERE l_returnflag = 'A'"""

# ---------------------------------------------------------------- commit history
VIEWS["v_commits"] = """
SELECT event_id AS commit_id, ts, concat('repo', CAST(k % 3 AS STRING)) AS repo_id,
  concat('src/d', CAST(k % 10 AS STRING), '/f', CAST(k AS STRING), '.ts') AS file,
  CASE WHEN k % 4 = 0 AND user_id % 8 <> 0 THEN 'a0' ELSE concat('a', CAST(user_id % 5 AS STRING)) END AS author
FROM (SELECT event_id, ts, user_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM {events}) e"""

# Last commit per file over several years, for staleness.
VIEWS["v_dated_commits"] = """
SELECT o_orderkey AS commit_id, o_orderdate AS ts, concat('repo', CAST(o_custkey % 40 AS STRING)) AS repo_id,
  concat(CASE WHEN o_custkey % 200 < 40 AND o_orderdate > TIMESTAMP '1996-01-01 00:00:00' THEN 'old' ELSE concat('d', CAST(o_custkey % 12 AS STRING)) END,
    '/f', CAST(o_custkey % 60 AS STRING), '.ts') AS file
FROM {orders}"""

VIEWS["v_blame"] = """
SELECT concat('repo', CAST(l_orderkey % 7 AS STRING)) AS repo_id, l_orderkey AS file_no, l_linenumber AS line_no,
  max(l_shipdate) AS author_ts
FROM {lineitem} GROUP BY concat('repo', CAST(l_orderkey % 7 AS STRING)), l_orderkey, l_linenumber"""

# ---------------------------------------------------------------- files and lines
VIEWS["v_files"] = """
SELECT source AS repo_id, concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.md') AS path, text AS content FROM {documents}"""

VIEWS["v_code_lines"] = """
SELECT concat('repo', CAST(l_orderkey % 7 AS STRING)) AS repo_id, l_orderkey AS file_no,
  concat(CASE l_orderkey % 9 WHEN 0 THEN 'lib' WHEN 1 THEN 'app/api/x' WHEN 2 THEN 'components/ui' WHEN 3 THEN 'src/__fixtures__/a'
      WHEN 4 THEN 'docs' WHEN 5 THEN 'node_modules/p' WHEN 6 THEN 'utils' WHEN 7 THEN 'lib/db' ELSE 'src/example.d' END,
    '/f', CAST(l_orderkey AS STRING),
    CASE l_orderkey % 5 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '.js' WHEN 3 THEN '.md' ELSE '.py' END) AS path,
  l_linenumber AS line_no,
  CASE l_partkey % 26
    WHEN 0 THEN 'const a: any = load()'
    WHEN 1 THEN 'return value as any;'
    WHEN 2 THEN '  const b = c as unknown as Foo'
    WHEN 3 THEN 'user!.name.trim()'
    WHEN 4 THEN '// @ts-ignore'
    WHEN 5 THEN '// @ts-expect-error legacy'
    WHEN 6 THEN '// TODO: remove this'
    WHEN 7 THEN '// FIXME handle nulls'
    WHEN 8 THEN '// see Notion for the plan'
    WHEN 9 THEN '// documented in confluence space, see slack'
    WHEN 10 THEN 'link https://team.atlassian.net/browse/AB-1 for details'
    WHEN 11 THEN concat('const password = ', chr(34), 'correct-horse-', CAST(l_orderkey AS STRING), chr(34), repeat(' ', CAST(l_suppkey % 3 AS INT)))
    WHEN 12 THEN concat('key AK', 'IA', repeat('Z', 16))
    WHEN 13 THEN 'db = postgres://user@host/db'
    WHEN 14 THEN concat('call s', 'k-', repeat('a', 24), ' ', repeat('tail ', 30))
    WHEN 15 THEN concat('gh', 'p_', repeat('b', 36))
    WHEN 16 THEN concat('-----BEGIN ', 'PRIVATE KEY-----')
    WHEN 17 THEN 'console.log(user, patient, 1)'
    WHEN 18 THEN 'let diagnosis = load("flu")'
    WHEN 19 THEN 'res.send(mrn)'
    WHEN 20 THEN 'throw new Error(phi)'
    WHEN 21 THEN 'localStorage.setItem(key, dob)'
    WHEN 22 THEN 'if (a && b) {{ return c ? d : e }}'
    WHEN 23 THEN 'for (const x of xs) {{ while (x || y) {{ step() }} }}'
    WHEN 24 THEN concat('Auth_Token: ', chr(39), 'abcdefgh12', chr(39), ' // see Notion')
    ELSE 'plain text with the usual words' END AS text
FROM {lineitem}"""

# Whole source files with imports, exports, routes and manifests; 160 consecutive keys form a repository.
VIEWS["v_code_files"] = """
SELECT concat('repo', CAST(r AS STRING)) AS repo_id,
  CASE kind
    WHEN 0 THEN concat('app/api/r', q, '/[id]/', CASE WHEN alt = 1 THEN '[...rest]/' ELSE '' END, 'route.ts')
    WHEN 1 THEN concat('app/p', q, '/page.tsx')
    WHEN 2 THEN concat('components/ui/c', q, '.tsx')
    WHEN 3 THEN concat('lib/db/t', q, '.ts')
    WHEN 4 THEN concat('lib/m', q, '.ts')
    WHEN 5 THEN concat('lib/ai/providers/p', q, '.ts')
    WHEN 6 THEN concat('utils/u', q, '.ts')
    WHEN 7 THEN concat('bin/b', q, '.ts')
    WHEN 8 THEN concat('mcp-server/t', q, '.ts')
    WHEN 9 THEN concat('src/m', q, '/index.ts')
    WHEN 10 THEN concat('scripts/s', q, '.py')
    WHEN 11 THEN concat('src/__fixtures__/f', q, '.generated.ts')
    WHEN 12 THEN concat('docs/d', q, '.md')
    WHEN 13 THEN concat(CASE WHEN alt = 0 THEN 'pkg/g' ELSE 'audit/g' END, q, '.go')
    WHEN 14 THEN concat('lib/m', q, '.test.ts')
    ELSE CASE n % 10
      WHEN 0 THEN 'package.json'
      WHEN 1 THEN CASE WHEN alt = 0 THEN 'tsconfig.json' ELSE 'tsconfig.base.json' END
      WHEN 2 THEN CASE WHEN alt = 1 THEN '.gitignore' ELSE '.env' END
      WHEN 3 THEN CASE WHEN alt = 2 THEN 'server/Dockerfile' ELSE 'Dockerfile' END
      WHEN 4 THEN CASE WHEN alt = 0 AND r % 4 = 0 THEN 'Cargo.toml' ELSE 'next.config.js' END
      WHEN 5 THEN CASE WHEN alt = 1 AND r % 3 = 0 THEN 'go.mod' ELSE '.github/workflows/ci.yml' END
      WHEN 6 THEN concat('packages/p', q, '/package.json')
      WHEN 7 THEN CASE WHEN alt = 0 THEN 'requirements.txt' ELSE 'eslint.config.js' END
      WHEN 8 THEN CASE WHEN alt = 0 THEN 'pyproject.toml' WHEN alt = 1 THEN 'pnpm-workspace.yaml' ELSE 'security/policy.md' END
      ELSE CASE WHEN alt = 0 THEN 'README.md' ELSE 'tools/x/AGENTS.md' END END
  END AS path,
  CASE kind
    WHEN 0 THEN concat('import {{ t', q, ' as table }} from ', chr(34), '@/lib/db/t', q, chr(34), chr(10),
        'export async function GET(req) {{', chr(10), CASE WHEN alt = 0 THEN '  try {{ return ok() }} catch (e) {{ }}' ELSE '  return ok()' END, chr(10), '}}', chr(10),
        'export function POST() {{ }}', chr(10), CASE WHEN alt = 2 THEN 'export async function GET() {{ }}' ELSE '' END)
    WHEN 1 THEN concat('// @role provider  public-api', chr(10), 'import {{ C', q, ' }} from ', chr(39), '@/components/ui/c', q, chr(39), ';', chr(10),
        'import {{ run', q, ', helper as h }} from ', chr(39), '@/lib/m', q, chr(39), ';', chr(10),
        CASE WHEN alt = 0 THEN concat('import {{ t', q, ' }} from ', chr(39), '../../lib/db/t', q, chr(39), ';', chr(10)) ELSE '' END,
        'export default function Page() {{ return cond ? 1 : 2 }}', chr(10), 'console.log(1)')
    WHEN 2 THEN concat('export const C', q, ' = () => null;', chr(10), 'export interface P', q, ' {{ }}')
    WHEN 3 THEN concat('export const t', q, ' = table();', chr(10), 'export type Row', q, ' = any', chr(10),
        CASE WHEN alt = 1 THEN concat('import {{ C', q, ' }} from ', chr(34), '@/components/ui/c', q, chr(34)) ELSE '' END)
    WHEN 4 THEN concat('import {{ run', nxt, ' }} from ', chr(39), './m', nxt, chr(39), chr(10),
        CASE WHEN alt = 0 THEN concat('const m = await import(', chr(39), './m', prv, chr(39), ')', chr(10)) ELSE '' END,
        'import fs from ', chr(39), 'fs', chr(39), chr(10),
        'const t = require(', chr(39), './db/t', q, chr(39), ')', chr(10),
        'export function run', q, '() {{ if (a && b) {{ for (;;) {{ }} }} }}', chr(10), 'export {{ helper, other as alias }}', chr(10), 'import * as self from ', chr(39), './m', q, chr(39))
    WHEN 5 THEN concat('import pino from ', chr(39), 'pino', chr(39), chr(10), 'export class P', q, ' {{ }}', chr(10), '// see wiki for /health')
    WHEN 6 THEN concat('import {{ run', q, ' }} from ', chr(39), '../lib/m', q, chr(39), chr(10), 'export let u', q, ' = 1')
    WHEN 7 THEN concat('#!/usr/bin/env node', chr(10), 'import ', chr(39), '../lib/m', q, '.ts', chr(39))
    WHEN 8 THEN concat('import {{ tool }} from ', chr(39), '../src/m', q, chr(39))
    WHEN 9 THEN CASE WHEN alt = 0
        THEN concat('// barrel', chr(10), 'export * from ', chr(39), '../../lib/m', q, chr(39), ';', chr(10), chr(10), 'export {{ t', q, ' }} from ', chr(39), '../../lib/db/t', q, chr(39), ';')
        ELSE concat('export * from ', chr(39), '../../lib/m', q, chr(39), ';', chr(10), 'const x = 1;') END
    WHEN 10 THEN concat('import os', chr(10), 'print(', q, ')')
    WHEN 11 THEN concat('export const data = [', repeat(concat('1,', chr(10)), CAST(n % 900 AS INT)), ']')
    WHEN 12 THEN concat('# Doc ', q, chr(10), 'See https://acme.notion.so/x and see jira', chr(10), repeat(concat('line', chr(10)), CAST(n % 700 AS INT)))
    WHEN 13 THEN concat('package g', chr(10), 'func F', q, '() {{ switch {{ case 1: }} }}')
    WHEN 14 THEN concat('import {{ run', q, ' }} from ', chr(39), './m', q, chr(39), chr(10), 'test(', chr(39), 'x', chr(39), ', () => {{ }})')
    ELSE CASE n % 10
      WHEN 0 THEN concat('{{"name":"', CASE WHEN alt = 1 THEN 'privacy-kit' ELSE 'kit' END, CAST(r AS STRING), '"',
          CASE WHEN alt = 0 THEN ',"main":"./dist/index.js","exports":{{".":{{"import":"./dist/index.mjs","require":"./dist/index.js"}}}}' ELSE '' END,
          CASE WHEN r % 2 = 0 THEN ',"description":"d","license":"MIT"' ELSE ',"workspaces":["packages/*","apps/**"]' END,
          ',"scripts":{{"', CASE WHEN r % 3 = 0 THEN 'test' ELSE 'start' END, '":"', CASE WHEN r % 3 = 0 THEN 'vitest' ELSE 'node x.js' END, '"}}',
          ',"dependencies":{{"', CASE r % 4 WHEN 0 THEN 'express' WHEN 1 THEN 'hono' WHEN 2 THEN 'pino' ELSE 'vite' END, '":"', CASE WHEN r % 5 = 0 THEN '*' ELSE '^1.2.3' END, '"}}}}')
      WHEN 1 THEN concat('{{ // compiler', chr(10), '"compilerOptions": {{ "strict": ', CASE WHEN r % 2 = 0 THEN 'true' ELSE 'false' END,
          CASE WHEN r % 3 = 0 THEN ', "noImplicitReturns": true' ELSE '' END, ', "skipLibCheck": true /* fast */ }} }}', CASE WHEN r % 7 = 0 THEN ' oops' ELSE '' END)
      WHEN 2 THEN concat('node_modules/', chr(10), CASE WHEN r % 2 = 0 THEN '.env' ELSE 'tmp' END, chr(10), 'dist')
      WHEN 3 THEN concat('FROM node', chr(10), CASE WHEN r % 2 = 0 THEN 'USER app' ELSE 'RUN ls' END)
      WHEN 4 THEN CASE WHEN r % 8 = 0 THEN '[[bin]]' ELSE 'module.exports = 1' END
      WHEN 5 THEN CASE WHEN r % 2 = 0 THEN 'require go.uber.org/zap' ELSE 'on: push' END
      WHEN 6 THEN concat('{{"name":"p', q, '"}}')
      WHEN 7 THEN CASE WHEN r % 2 = 0 THEN 'sentry-sdk' ELSE 'flask' END
      WHEN 8 THEN concat('packages:', chr(10), '  - ', chr(39), 'libs/*', chr(39), chr(10), '  - tools/x', chr(10), 'other: 1')
      ELSE concat('# Readme ', q) END
  END AS content
FROM (SELECT CAST(floor(o_orderkey / 160) AS BIGINT) AS r, o_orderkey % 16 AS kind, CAST(floor(o_orderkey / 16) AS BIGINT) AS n,
        CAST(CAST(floor(o_orderkey / 16) AS BIGINT) AS STRING) AS q, CAST(CAST(floor(o_orderkey / 16) AS BIGINT) + 1 AS STRING) AS nxt,
        CAST(CAST(floor(o_orderkey / 16) AS BIGINT) - 3 AS STRING) AS prv, o_custkey % 3 AS alt
      FROM {orders}) f"""

# The same files with some folders missing per repository, so that traits differ between repositories.
VIEWS["v_sliced_files"] = VIEWS["v_code_files"] + """
WHERE NOT ((r % 3 <> 0 AND kind = 8) OR (r % 2 = 1 AND kind IN (0, 1, 2)) OR (r % 5 <> 0 AND kind IN (7, 10)) OR (r % 4 <> 1 AND kind = 13 AND alt <> 0))"""

# ---------------------------------------------------------------- graph
VIEWS["v_edges"] = """
SELECT DISTINCT concat('repo', CAST(l_suppkey AS STRING)) AS repo_id, l_orderkey % 200 AS src, (l_partkey * 7 + l_linenumber) % 200 AS dst
FROM {lineitem} WHERE l_orderkey % 200 <> (l_partkey * 7 + l_linenumber) % 200"""

VIEWS["v_path_edges"] = """
SELECT DISTINCT repo_id,
  concat(CASE src % 8 WHEN 0 THEN 'app/api' WHEN 1 THEN 'app' WHEN 2 THEN 'components/ui' WHEN 3 THEN 'lib/db' WHEN 4 THEN 'lib' WHEN 5 THEN 'utils' WHEN 6 THEN 'bin' ELSE 'misc' END, '/f', CAST(src AS STRING), '.ts') AS src,
  concat(CASE dst % 8 WHEN 0 THEN 'app/api' WHEN 1 THEN 'app' WHEN 2 THEN 'components/ui' WHEN 3 THEN 'lib/db' WHEN 4 THEN 'lib' WHEN 5 THEN 'utils' WHEN 6 THEN 'bin' ELSE 'misc' END, '/f', CAST(dst AS STRING), '.ts') AS dst
FROM {v_edges}"""

# ---------------------------------------------------------------- dependencies
VIEWS["v_deps"] = """
SELECT concat('repo', CAST(l_suppkey AS STRING)) AS repo_id, concat('pkg', CAST(l_partkey AS STRING)) AS name,
  min(concat(CASE l_linenumber % 3 WHEN 0 THEN '^' WHEN 1 THEN '~' ELSE '' END, CAST(l_linenumber AS STRING), '.', CAST(CAST(l_quantity AS INT) AS STRING), '.', CAST(l_orderkey % 10 AS STRING))) AS current
FROM {lineitem} GROUP BY concat('repo', CAST(l_suppkey AS STRING)), concat('pkg', CAST(l_partkey AS STRING))"""

VIEWS["v_registry"] = """
SELECT concat('pkg', CAST(p_partkey AS STRING)) AS name,
  CASE WHEN p_partkey % 13 = 0 THEN '--' ELSE concat(CAST(1 + p_size % 8 AS STRING), '.', CAST(p_size AS STRING), '.', CAST(p_partkey % 10 AS STRING)) END AS latest
FROM {part}"""

VIEWS["v_advisories"] = """
SELECT concat('pkg', CAST(p_partkey AS STRING)) AS name, concat('ADV-', CAST(p_partkey AS STRING)) AS advisory_id,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat(CAST(p_size % 3 AS STRING), '.0.0') END AS lo,
  concat(CAST(3 + p_size % 5 AS STRING), '.', CAST(p_size % 30 AS STRING), '.0') AS hi,
  CASE p_size % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'moderate' WHEN 3 THEN 'low' ELSE 'weird' END AS severity,
  concat('Flaw in ', p_name) AS title, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('https://advisories.example/', CAST(p_partkey AS STRING)) END AS url,
  CASE WHEN p_partkey % 2 = 0 THEN concat(CAST(3 + p_size % 5 AS STRING), '.', CAST(p_size % 30 AS STRING), '.0') ELSE NULL END AS fixed
FROM {part} WHERE p_partkey % 3 = 0"""

# ---------------------------------------------------------------- tool output
VIEWS["v_lcov_lines"] = """
SELECT o_custkey AS report_id, o_orderkey * 4 + 1 AS line_no, concat('SF:src/f', CAST(o_orderkey % 9000 AS STRING), '.ts') AS text FROM {orders}
UNION ALL SELECT o_custkey, o_orderkey * 4 + 2, concat(' LF:', CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 20 + o_orderkey % 80 END AS STRING)) FROM {orders}
UNION ALL SELECT o_custkey, o_orderkey * 4 + 3, concat('LH:', CASE WHEN o_orderkey % 31 = 0 THEN 'x' ELSE CAST(o_orderkey % 20 AS STRING) END) FROM {orders}
UNION ALL SELECT o_custkey, o_orderkey * 4 + 4, 'end_of_record' FROM {orders} WHERE o_orderkey % 11 <> 0"""

VIEWS["v_coverage_json"] = """
SELECT o_orderkey AS report_id, concat('{{',
  CASE WHEN o_orderkey % 3 = 0 THEN concat('"total":{{"lines":{{"total":200,"covered":', CAST(o_custkey % 200 AS STRING), ',"pct":', CAST(o_custkey % 100 AS STRING), '.5}}}},') ELSE '' END,
  '"src/a', CAST(o_orderkey % 50 AS STRING), '.ts":{{"lines":{{"total":100,"covered":', CAST(o_custkey % 100 AS STRING), ',"pct":', CAST(o_custkey % 100 AS STRING), '}}}},',
  '"src/b.ts":{{"lines":{{"total":40,"covered":', CAST(o_orderkey % 40 AS STRING), ',"pct":', CAST((o_orderkey % 40) * 2.5 AS STRING), '}}}}}}') AS doc
FROM {orders}"""

VIEWS["v_log_lines"] = """
SELECT l_orderkey AS run_id, l_linenumber AS line_no,
  CASE WHEN l_orderkey % 4 = 0 THEN CASE l_partkey % 3 WHEN 0 THEN 'starting build' WHEN 1 THEN concat('step ', CAST(l_partkey AS STRING)) ELSE '' END
  ELSE CASE l_partkey % 12
    WHEN 0 THEN concat('src/main.rs:', CAST(l_linenumber * 7 AS STRING), ':5: error: mismatched types')
    WHEN 1 THEN concat('src/a.c:', CAST(l_linenumber AS STRING), ':1: warning: unused variable')
    WHEN 2 THEN concat('src/b.ts(', CAST(l_linenumber AS STRING), ',3): error TS2322: bad type')
    WHEN 3 THEN 'error[E0308]: mismatched types'
    WHEN 4 THEN 'warning: deprecated'
    WHEN 5 THEN concat('pkg/x.go:', CAST(l_linenumber AS STRING), ': unreachable code')
    WHEN 6 THEN concat('    Updating cc v1.', CAST(l_linenumber AS STRING), '.59 -> v', CAST(1 + l_suppkey % 2 AS STRING), '.', CAST(l_suppkey % 8 AS STRING), '.60')
    WHEN 7 THEN concat('   Unchanged text v0.15.0 (available: v0.', CAST(15 + l_suppkey % 3 AS STRING), '.2)')
    WHEN 8 THEN concat('ok  pkg/a 0.5s coverage: ', CAST(l_partkey % 100 AS STRING), '.', CAST(l_suppkey % 10 AS STRING), '% of statements')
    WHEN 9 THEN '?   pkg/b [no test files]'
    WHEN 10 THEN '--- FAIL: TestX (0.00s)'
    ELSE concat('test result: ok. ', CAST(l_partkey % 50 AS STRING), ' passed; ', CAST(l_suppkey % 3 AS STRING), ' failed; 1 ignored') END END AS text,
  CAST(CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE 1 + l_orderkey % 2 END AS INT) AS exit_code
FROM {lineitem}"""

VIEWS["v_audit_docs"] = """
SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 3 = 0
  THEN concat('{{"advisories":{{"', CAST(p_partkey AS STRING), '":{{"severity":"', CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'moderate' WHEN 2 THEN 'low' ELSE 'odd' END, '","title":"Old flaw","module_name":"pkg', CAST(p_partkey AS STRING), '"', CASE WHEN p_size % 2 = 0 THEN ',"url":"https://a.example/1"' ELSE '' END, '}}}}}}')
  WHEN p_partkey % 31 = 1 THEN 'oops {{'
  ELSE concat('{{"vulnerabilities":{{"pkg', CAST(p_partkey AS STRING), '":{{"severity":"', CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'moderate' WHEN 2 THEN 'high' ELSE 'low' END, '","via":["dep"', CASE WHEN p_size % 3 = 0 THEN '' ELSE concat(',{{"title":"Flaw ', CAST(p_size AS STRING), '","url":"https://b.example/', CAST(p_partkey AS STRING), '"}},{{"title":"second"}}') END, '],"fixAvailable":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, '}},"other":{{"severity":"info","via":[],"fixAvailable":{{"name":"x"}}}}}}}}') END AS doc
FROM {part}"""

VIEWS["v_ndjson"] = """
SELECT l_orderkey AS run_id, l_linenumber AS line_no, CASE l_partkey % 6 WHEN 0 THEN '{{"reason":"build-finished","success":true}}' WHEN 1 THEN 'not json' WHEN 2 THEN '{{"reason":"compiler-message","message":{{"level":"note","message":"n","spans":[]}}}}'
  WHEN 3 THEN '{{"reason":"compiler-message","message":{{"level":"warning","message":"2 warnings generated","code":null,"spans":[]}}}}'
  ELSE concat('{{"reason":"compiler-message","message":{{"level":"', CASE WHEN l_partkey % 6 = 4 THEN 'warning' ELSE 'error' END, '","message":"m', CAST(l_partkey % 9 AS STRING), '","code":', CASE WHEN l_suppkey % 2 = 0 THEN 'null' ELSE '{{"code":"dead_code"}}' END,
    ',"spans":[{{"file_name":"src/f', CAST(l_suppkey AS STRING), '.rs","line_start":', CAST(l_linenumber AS STRING), '}},{{"file_name":"src/z.rs","line_start":1}}]}}}}') END AS text
FROM {lineitem}"""

VIEWS["v_concat_docs"] = """
SELECT o_orderkey AS doc_id, concat('{{"Path":"root","Main":true}}', chr(10), '{{"Path":"m', CAST(o_custkey AS STRING), '","Version":"v1.', CAST(o_custkey % 9 AS STRING), '.0"',
  CASE WHEN o_orderkey % 2 = 0 THEN ',"Update":{{"Version":"v2.0.0"}}' ELSE '' END, '}} {{"Path":"n","Version":"v0.1.0"}}') AS doc
FROM {orders}"""

VIEWS["v_vuln_docs"] = """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 2 = 0
  THEN concat('{{"vulns":[{{"osv":{{"id":"GO-', CAST(o_orderkey AS STRING), '","summary":"s","database_specific":{{"severity":"MODERATE"}}}},"modules":[{{"path":"m/a","fixed_version":"v1.2.3"}}]}}]}}')
  ELSE concat('{{"config":{{"v":1}}}}', chr(10), '{{"osv":{{"id":"GO-', CAST(o_custkey AS STRING), '"}}}}', chr(10), 'garbage', chr(10), chr(10), '{{"osv":{{"id":"GO-X","database_specific":{{"severity":"high"}}}},"modules":[{{"path":"m/b","packages":[{{"callstacks":[1]}}]}}]}}',
    CASE WHEN o_orderkey % 3 = 0 THEN concat(chr(10), '{{"osv":{{"id":"GO-Y","summary":"y"}},"modules":[{{"path":"m/c","packages":[{{"callstacks":[1]}}]}}]}}') ELSE '' END) END AS doc
FROM {orders}"""

VIEWS["v_lint_docs"] = """
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 10 = 9 THEN 'failed to load config' ELSE concat('[{{"filePath":"src/a', CAST(o_custkey % 20 AS STRING), '.ts","messages":[{{"line":', CAST(o_orderkey % 300 AS STRING), ',"severity":', CAST(1 + o_orderkey % 2 AS STRING), ',"message":"bad","ruleId":"no-bad"}},{{"severity":2,"message":"parse","ruleId":null}}]}},{{"filePath":"src/ok.ts","messages":[]}}]') END AS doc
FROM {orders}"""

VIEWS["v_lock_files"] = """
SELECT concat('repo', CAST(c_custkey AS STRING)) AS repo_id, concat('version = 3', chr(10), repeat(concat('[[package]]', chr(10), 'name = "x"', chr(10)), CAST(c_custkey % 40 AS INT))) AS content FROM {customer}"""

VIEWS["v_runs"] = """
SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'build' WHEN 1 THEN 'lint' WHEN 2 THEN 'typecheck' ELSE 'test' END AS module_id,
  CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE 'npm run x' END AS command, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 + o_orderkey % 2 END AS INT) AS exit_code
FROM {orders}"""

VIEWS["v_probes"] = """
SELECT concat('repo', CAST(user_id AS STRING)) AS repo_id, event_id AS probe_id,
  CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'POST' WHEN 'purchase' THEN 'PUT' WHEN 'signup' THEN 'PATCH' ELSE 'DELETE' END AS method,
  concat('/api/r', CAST(event_id % 40 AS STRING)) AS route,
  CASE WHEN event_id % 21 = 0 THEN NULL ELSE CAST(CASE event_id % 6 WHEN 0 THEN 200 WHEN 1 THEN 201 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 503 ELSE 400 END AS INT) END AS status,
  CAST(floor(value * 40) AS INT) AS response_ms, event_id % 5 <> 0 AS is_json,
  CASE WHEN event_id % 21 = 0 THEN 'timeout' ELSE NULL END AS error
FROM {events}"""

VIEWS["v_progress"] = """
SELECT user_id AS scan_id, event_type AS module_id, ts, event_id AS seq, CAST(floor(value) AS INT) % 101 AS pct,
  CASE WHEN value > 60 THEN 'completed' WHEN value > 45 THEN 'failed' ELSE 'running' END AS status
FROM {events}"""

VIEWS["v_rules_raw"] = """
SELECT p_partkey AS rule_no, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE concat('rule-', CAST(p_partkey AS STRING)) END AS id,
  p_name AS name, CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE 'finds things' END AS description, 'console.log($A)' AS pattern,
  CASE p_size % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'cobol' ELSE 'typescript' END AS language,
  CASE p_size % 7 WHEN 0 THEN 'severe' WHEN 1 THEN 'critical' WHEN 2 THEN 'low' ELSE 'high' END AS severity,
  concat('avoid ', p_name) AS message, CASE WHEN p_partkey % 23 = 0 THEN '' ELSE 'style' END AS category
FROM {part}"""

# User rules of several languages: with and without a text that every match contains.
VIEWS["v_user_rules"] = """
SELECT concat('user-', CAST(n_nationkey AS STRING)) AS id, n_name AS name, n_nationkey AS rule_no,
  CASE n_nationkey % 7 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'TSX' ELSE 'typescript' END AS language,
  CASE n_nationkey % 9 WHEN 0 THEN concat('correct-horse-', CAST(n_nationkey * 11 AS STRING)) WHEN 1 THEN concat('correct-horse-[', CAST(n_nationkey % 10 AS STRING), ']{{2}}', CAST(n_regionkey % 10 AS STRING))
    WHEN 2 THEN concat('absent_word_', CAST(n_nationkey AS STRING)) WHEN 3 THEN concat('(?i)CONST [a-z]+ = .*', CAST(n_nationkey AS STRING), '[^0-9]')
    WHEN 4 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'TODO|FIXME' ELSE concat('secret_', CAST(n_nationkey AS STRING)) END
    WHEN 5 THEN concat('horse-.?', CAST(n_nationkey % 1000 AS STRING), '[^0-9]') ELSE concat('horse-', CAST(n_nationkey AS STRING), '[^0-9]') END AS pattern,
  CASE n_regionkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, 'style' AS category,
  concat('avoid ', n_name) AS message, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE concat('use ', n_name) END AS suggestion
FROM {nation}"""

VIEWS["v_config_docs"] = """
SELECT c_custkey AS repo_id, concat('{{"thresholds":{{"complexity":', CAST(c_custkey % 130 AS STRING), '}},"aiTokenBudget":', CAST(c_custkey % 9 - 1 AS STRING),
  ',"tier":"', CASE c_custkey % 5 WHEN 0 THEN 'turbo' WHEN 1 THEN 'max' ELSE 'pro' END, '","profile":"',
  CASE c_custkey % 6 WHEN 0 THEN 'solo' WHEN 1 THEN 'library' WHEN 2 THEN 'unknown' WHEN 3 THEN 'team' WHEN 4 THEN 'enterprise' ELSE 'cli' END,
  '","commands":{{"test":', CASE c_custkey % 4 WHEN 0 THEN '42' WHEN 1 THEN 'null' ELSE '"npm test"' END, CASE c_custkey % 8 WHEN 0 THEN ',"ci":true' WHEN 1 THEN ',"deploy":5' ELSE ',"ci":null' END,
  '}},"modules":{{"security":', CASE c_custkey % 7 WHEN 0 THEN '"yes"' ELSE 'true' END, '}},"ignore":', CASE c_custkey % 11 WHEN 0 THEN '"dist"' WHEN 1 THEN '["a",1]' WHEN 2 THEN '[]' ELSE '["dist/**"]' END,
  ',"classify":{{"lib/x":', CASE c_custkey % 13 WHEN 0 THEN '5' WHEN 1 THEN '["ui-kit",null]' WHEN 2 THEN '["ui-kit"]' ELSE '"ui-kit"' END,
  '}},"auditPrompts":', CASE c_custkey % 10 WHEN 0 THEN '{{"a":false}}' WHEN 1 THEN 'null' ELSE '{{"a":"b"}}' END, '}}') AS doc
FROM {customer}"""

VIEWS["v_reviews"] = """
SELECT conv_id, turn, concat('r', CAST(conv_id AS STRING), '-', CAST(turn AS STRING)) AS response_id,
  CASE turn % 4
    WHEN 0 THEN concat('Here you go:', chr(10), '```json', chr(10), '{{"summary":"s', CAST(turn AS STRING), '","findings":[{{"severity":"high","file":"a.ts","line":', CAST(conv_id AS STRING), ',"message":"m"}},{{"message":"n","category":"naming"}},{{"file":"x.ts"}}]}}', chr(10), '```')
    WHEN 1 THEN concat('  {{"summary":"raw","findings":[{{"message":"k', CAST(conv_id AS STRING), '","severity":"low"}}]}}')
    WHEN 2 THEN concat('Result {{"summary":"wrapped"}} done. ', text)
    ELSE text END AS text
FROM {conversations}"""


def _refs(text: str) -> list[str]:
    """Inputs of a view text in first-use order."""
    seen: list[str] = []
    for _, name, _, _ in string.Formatter().parse(text):
        if name and name not in seen:
            seen.append(name)
    return seen


# Views that make up texts and paths with long CASE ladders.
TEXT_VIEWS = ("v_code_lines", "v_code_files", "v_sliced_files", "v_path_edges")


# Views that make a text of every row of a narrow table: its rows are dealt out first, because a file
# with few row groups would be few tasks however much work a row is. Small tables stay one partition (AQE).
SPREAD = {"v_code_files": {"orders": "o_orderkey"}, "v_sliced_files": {"orders": "o_orderkey"}, "v_config_docs": {"customer": "c_custkey"}}


class Tables:
    """The supplied tables and adapter views of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            if name in VIEWS:
                keys = SPREAD.get(name, {})
                inputs = {ref: self[ref].repartition(keys[ref]) if ref in keys else self[ref] for ref in _refs(VIEWS[name])}
                view = self.spark.sql(VIEWS[name], **inputs)
                self._cache[name] = computed_once(view) if name in TEXT_VIEWS else view
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._cache[name]


def oracle_ctes(names: tuple[str, ...]) -> list[str]:
    """``name AS (text)`` for the given views and the views they use, inputs first."""
    done: dict[str, str] = {}

    def visit(name: str) -> None:
        if name in done or name not in VIEWS:
            return
        refs = _refs(VIEWS[name])
        for ref in refs:
            visit(ref)
        done[name] = f"{name} AS ({VIEWS[name].format(**{ref: ref for ref in refs})})"

    for name in names:
        visit(name)
    return list(done.values())
