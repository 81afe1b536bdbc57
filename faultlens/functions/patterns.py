"""Detection patterns in Java dialect.

These patterns must match the published classifier for equal results. ``(?d)`` keeps only ``\\n`` as a line end.
"""
from __future__ import annotations


def ci(pattern: str) -> str:
    return "(?di)" + pattern


def cs(pattern: str) -> str:
    return "(?d)" + pattern


# ---- stage markers
TEST_MARKERS = ci(
    r"pytest|test session starts|===== FAILURES|===== ERRORS|Ran \d+ test|Testsuite:|make test|npm test|go test|"
    r"running \d+ tests|\b(?:rspec|junit|cargo test)\b|--- FAIL:|test result: FAILED|Failure/Error:|"
    r"FAIL\s+\S+\.(?:test|spec)\.[jt]sx?\b|A total of \d+ test files? matched|Failed!\s+-\s*Failed:|"
    r"Tests run:[^\n]*<<< FAILURE|\.test\.[jt]sx?:\d+:\d+"
)
PYTEST_FAILED = cs(r"\bFAILED\b")
BUILD_MARKERS = ci(
    r"compil|gcc |make[:\s]|undefined reference|cannot find|go build|npm run build|tsc |cargo build|ImportError|"
    r"ModuleNotFoundError|error TS\d+|error [A-Z]{1,5}\d+\b|error\[E\d+\]|::error::|could not install packages|"
    r"\bat\s+[\w.$]+\([^)]*\.java:\d+\)"
)
CI_MARKERS = ci(
    r"build started|running job|job .* (?:start|fail)|ci/circleci|gitlab-ci|stage:|pipeline|workflow .* fail|"
    r"\b(?:checkout|artifact (?:upload|download)|cache (?:restore|save))\s+(?:step\s+)?failed\b"
)
DEPLOY_MARKERS = ci(
    r"\bdeployment\b.*\b(?:rollout|progress deadline|updated replicas|readiness|failed)\b|"
    r"\bdeploy(?:ing|ment)?\s+(?:api|app|service|workload|release)\b|kubectl\b|helm\b|terraform (?:apply|plan)|"
    r"argo ?cd|rollout status|release \S+ (?:failed|pending)|"
    r"(?:readiness|liveness) probe|healthcheck|health check|imagepullbackoff|errimagepull|"
    r"back-off pulling image|migration (?:failed|error)|"
    r"\b(?:deployment|release|rollout|helm)\b[^\n]*\brollback\b|"
    r"\brollback(?:ing|ed)?\s+(?:deployment|release|rollout)\b|"
    r"\b(?:ecs|codedeploy|cloudformation|ansible|pulumi|nomad|flux|gcloud run|cloud deploy|serverless|sls|"
    r"docker stack|docker compose|systemctl)\b|"
    r"\b(?:crashloopbackoff|oomkilled|create_failed|rollback_in_progress|play recap|allocation failed|helmrelease|"
    r"failedscheduling|unschedulable|resourcequota|exceeded quota|image pull access denied|registry authentication|"
    r"required environment variable|configmap .* not found|secret .* not found)\b|"
    r"\bcontainer\b[^\n]{0,80}\b(?:exit(?:ed)?|status)\s*(?:code\s*)?137\b"
)

# ---- kind patterns
IMPORT = ci(r"(?:ImportError|ModuleNotFoundError|No module named)")
COMPILE = ci(
    r"[^:\n]+\.(?:c|cc|cpp|cxx|h|hpp|go|rs|java):\d+(?::\d+)?:\s*error:|"
    r"::error::|undefined reference|\bundefined:\s*[A-Za-z_]|cannot find|cannot open source|"
    r"error TS\d+|error [A-Z]{1,5}\d+\b|error\[E\d+\]|compilation error|no member named|\[build failed\]"
)
TIMEOUT = ci(
    r"TimeoutError|timed?\s+out|timeout exceeded|deadline exceeded|context deadline|worker timeout"
)
RERUN_RESULT = cs(
    r"^\s*(?:(\S+::\S+)\s+(FAILED|PASSED|RERUN)\b|(FAILED|PASSED|RERUN)\s+(\S+::\S+)\b)"
)
GO_COUNT = ci(r"\bgo test\b[^\n]*\s-count=(?:[2-9]|[1-9]\d+)\b")
GO_RESULT = cs(r"^--- (PASS|FAIL):\s+(\S+)(?:\s+\(|$)")
JEST_FLAKY_SUMMARY = ci(r"Tests?:[^\n]*\bflaky\b")
FLAKY_POSITION = ci(r"\bRERUN\b|[✕●]\s+")
TEST_FAIL = ci(
    r"(?m:^\s*(?:FAILED\s+\S+::\S+|\S+::\S+\s+FAILED\b|"
    r"FAIL\s+\S+\.(?:test|spec)\.[jt]sx?\b|"
    r"=+\s*(?:FAILURES|ERRORS)\s*=+|--- FAIL:|"
    r"(?:E\s+)?(?:[\w.]+\.)?(?:AssertionError|ValueError|TypeError|RuntimeError|KeyError|IndexError|"
    r"\w*Exception)(?::|\s*$)|"
    r"E\s+assert\b|Failure/Error:|[✕●×]\s+\S|"
    r"Assert\.\w+\(\)\s+Failure|thread .+ panicked at|"
    r"test result:\s*FAILED\b|"
    r"(?:=+\s*)?(?:\d+\s+(?:passed|skipped|deselected|xfailed|xpassed|warnings?)[,; ]+)*"
    r"[1-9]\d*\s+(?:failed|errors?|failures?)\b|"
    r"(?:\[(?:INFO|ERROR)\]\s*)?(?:Tests?(?: Suites?| Files)?|Tests run):[^\n]*"
    r"(?:\b[1-9]\d*\s+failed\b|\b(?:Failures|Errors|Failed):\s*[1-9]\d*\b)|"
    r"Failed!\s*-\s*Failed:\s*[1-9]\d*\b|"
    r"FAILED\s*\((?:failures|errors)=[1-9]\d*\b))"
)
CRASH = ci(r"segmentation fault|segfault|SIGSEGV|SIGABRT|panic:")
IMAGE_PULL = ci(r"imagepullbackoff|errimagepull|back-off pulling image|failed to pull image")
REGISTRY_AUTH = ci(
    r"(?:pull access denied|authentication required|unauthorized)[^\n]{0,120}(?:image|registry|repository)|"
    r"(?:image|registry|repository)[^\n]{0,120}(?:authentication required|unauthorized|access denied)|"
    r"(?:failed to authorize|oauth[^\n]*(?:token|auth)|token exchange failed)[^\n]{0,120}(?:pull|image|registry)"
)
OOM = ci(
    r"oomkilled|out of memory|memory cgroup out of memory|"
    r"(?:container|process|command)\b[^\n]{0,80}\b(?:exit(?:ed)?|status)(?:\s+with)?\s*(?:code\s*)?137\b"
)
CRASH_LOOP = ci(r"crashloopbackoff|back-off restarting failed container")
LIVENESS = ci(r"(?:liveness\s+probe|probe\s+liveness)[^\n]{0,80}\bfailed\b")
HEALTH = ci(r"(?:health\s*check|healthcheck)[^\n]{0,80}\bfailed\b")
READINESS_PROBE = ci(r"(?:readiness\s+probe|probe\s+readiness)[^\n]{0,80}\bfailed\b")
SCHEDULING = ci(r"(?:failedscheduling|0/\d+ nodes are available|unschedulable)")
QUOTA = ci(r"(?:exceeded quota|resourcequota|insufficient (?:cpu|memory))")
NETWORK = ci(
    r"(?:dns|network|name resolution)[^\n]{0,100}(?:failed|error|unreachable|refused)|"
    r"failed to resolve host|temporary failure in name resolution|ENOTFOUND|"
    r"connection refused|connection reset|no route to host|network is unreachable|networkpolicy[^\n]*denied"
)
CONFIG = ci(
    r"(?:configmap|secret).*(?:not found|missing)|(?:missing|required) (?:environment variable|configuration)"
)
MIGRATION = ci(r"migration (?:failed|error)|failed migration|migrate.*(?:failed|error)")
PERMISSION = ci(r"forbidden|permission denied|unauthorized|access denied")
ROLLBACK = ci(r"rollback(?:ing|ed)?|rollout undo")
ROLLBACK_DONE_ANYWHERE = ci(r"(?:rollback|rolled back).*(?:succeed|complete)")
ROLLBACK_DONE_NEAR = ci(r"(?:rollback|rolled back)[^\n]{0,100}(?:succeed|complete|successfully)")
READINESS = ci(
    r"(?:readiness|liveness) probe failed|failed to become ready|containers? not ready|crashloopbackoff|oomkilled"
)
DEPLOY_TIMEOUT = ci(
    r"(?:rollout|deploy(?:ment)?|release).*?(?:timed? ?out|deadline exceeded|exceeded (?:its )?progress deadline)|"
    r"timed out waiting for (?:the )?(?:condition|rollout)"
)
DEPLOY_FAILURE = ci(
    r"(?:deployment|release|rollout|terraform apply|helm upgrade|ecs|codedeploy|cloudformation|ansible|pulumi|nomad|"
    r"flux|gcloud run|serverless|docker (?:stack|compose)|systemctl).*?(?:failed|error)|"
    r"apply failed|create_failed|failed=1|allocation failed"
)
CI_FAILURE = ci(
    r"(?:job|pipeline|workflow|step)\b[^\n]*\b(?:failed|failure)\b|"
    r"(?:exit (?:code|status)|process completed with exit code)\s*[1-9]\d*"
)
CI_FOOTER = ci(r"process completed with exit code\s*[1-9]\d*")
DEPENDENCY = ci(
    r"\bERESOLVE\b|unable to resolve dependency tree|could not resolve dependency|"
    r"ResolutionImpossible|have conflicting dependencies|"
    r"Fix the upstream dependency conflict|(?:peer )?dependency conflict between|"
    r"could not resolve all files|could not find .* artifact|"
    r"poetry[^\n]*(?:solver|version solving|because)|"
    r"failed to select a version for|failed to select a version|cargo[^\n]*(?:failed to select|failed to resolve)"
)
DISK_FULL = ci(
    r"No space left on device|\[Errno 28\]|\bENOSPC\b|disk space.*exhausted|100%.*(?:disk|storage).*used|"
    r"not enough space|ephemeral-storage|disk quota exceeded"
)
TLS = ci(
    r"certificate (?:has expired|verify failed)|SSL certificate problem|CERTIFICATE_VERIFY_FAILED|"
    r"x509:\s*certificate|self signed certificate in certificate chain"
)
RATE_LIMIT = ci(
    r"HTTP 429|429 Too Many Requests|secondary rate limit|rate limit exceeded|\btoomanyrequests\b|API rate limit|"
    r"ThrottlingException|Retry-After\s*[:=]|\bstatus\s*[:=]\s*429\b"
)
GENERIC_ERROR = ci(r"error:\s")

# ---- message and line patterns
ERROR_LINE = ci(r"error|failed|fail|exception|traceback|crash|panic")
STRONG_ERROR = ci(
    r"error:|(?m:^\s*(?:E\s+)?(?:[\w.]+\.)?AssertionError\b)|E\s+assert|ModuleNotFoundError|ImportError|"
    r"undefined reference|segmentation fault|panic:|No module named|npm ERR! code"
)
CHAINED_TRACEBACK = ci(
    r"During handling of the above exception|The above exception was the direct cause"
)
NPM_CODE = ci(r"^\s*npm ERR!\s+code\s+\S+")
NPM_ROW = ci(r"^\s*npm ERR!\s+")
NPM_NOISE = ci(r"^\s*npm ERR!\s+(?:code|errno)\b")
K8S_HEADER = ci(r"^\s*Events:\s*$")
K8S_WARNING = ci(
    r"^\s*Warning\b.*\b(?:failed|failure|back-off|oomkilled|unhealthy|errimagepull|imagepullbackoff|denied|"
    r"deadline|timeout)\b"
)
ANSI = r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07]*(?:\x07|\x1b\\))"
CI_PREFIX = ci(r"^\s*(?:##\[(?:error|warning|command)\]|(?:ERROR|WARN(?:ING)?):)\s*")
SUMMARY_TEST_LINE = ci(r"(?:FAILED\s+\S+::\S+|\S+::\S+\s+FAILED)\b")
SUMMARY_TEST_DETAIL = ci(r"assert|assertion|exception|error|timeout|timed?\s*out")

# ---- trace and clock fields
TRACEPARENT = r"00-([0-9a-fA-F]{32})-([0-9a-fA-F]{16})-([0-9a-fA-F]{2})"
TRACE_FIELD = r"\b(?:trace_id|traceId|trace-id)\s*[=:]\s*([0-9a-fA-F]{16,32})"
SPAN_FIELD = r"\b(?:span_id|spanId|span-id)\s*[=:]\s*([0-9a-fA-F]{8,16})"
PARENT_FIELD = r"\b(?:parent_span_id|parentSpanId|parent-span-id)\s*[=:]\s*([0-9a-fA-F]{8,16})"
NS_FIELD = r"\b(?:timestamp_ns|time_ns|ts_ns)\s*[=:]\s*(\d{13,19})"
SEQUENCE_FIELD = r"\b(?:sequence|seq)\s*[=:]\s*(\d{1,9})"
ISO_TIME = r"(?<!\d)(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?(?:Z|[+-]\d{2}:?\d{2})?)(?!\d)"

# ---- stack frames
_CONFIG_PATH = r"(?:[A-Za-z]:[\\/]|/)?(?:[A-Za-z0-9_.-]+[\\/])*[A-Za-z0-9_.-]+\.(?:yaml|yml|tf|tpl)"
PY_FRAME = r'File "([^"]+)", line (\d+)(?:, in (.+))?'
PY_FRAME_IN = r"\s+([^:\n]+\.py):(\d+):\s+in (\S+)"
PY_FRAME_SHORT = r"^([^:\n]+\.py):(\d+):\s*(.+)?$"
COMPILE_FRAME = ci(r"([^:\n]+\.(?:c|cpp|cc|h|ts|js|go|rs|java)):(\d+):(\d+):\s+error:?\s+(.+)")
CONFIG_FRAME = ci(r"(?<![A-Za-z0-9_./-])(" + _CONFIG_PATH + r"):([1-9]\d*)(?::[1-9]\d*)?(?=\s|$|:)")
TERRAFORM_FRAME = ci(r"\bon\s+(" + _CONFIG_PATH + r")\s+line\s+([1-9]\d*)\b")
JAVA_FRAME = r"^\s*at\s+([\w$.]+)\(([\w./\\$-]+\.java):(\d+)\)"
V8_FRAME = r"^\s*at\s+(.+?)\s+\(([^\s()]+):(\d+):(\d+)\)\s*$"
CSHARP_FRAME = ci(r"^\s*at\s+.+?\sin\s+([^\s:]+\.cs):line\s+(\d+)")

# ---- failed tests
FAILED_LINE = r"^(?:FAILED|ERROR)\s+([^\s]+)\s*-\s*(.*)$"
HEADER_LINE = r"^_{5,}\s*(.*?)\s*_{5,}$"
JEST_FAIL_FILE = ci(r"^FAIL\s+(\S+\.(?:test|spec)\.[jt]sx?)\b")
VITEST_FAIL = ci(r"^FAIL\s+(\S+\.(?:test|spec)\.[jt]sx?)\s*>\s*(.+?)\s*$")
JEST_TEST_NAME = r"^\s*[●✕×]\s+(.+?)\s*$"
JEST_EXPECTED = r"^\s*Expected:\s*(.+?)\s*$"
JEST_RECEIVED = r"^\s*Received:\s*(.+?)\s*$"
GO_FAIL = r"^--- FAIL:\s+(\S+)(?:\s+\(|$)"
GO_LOCATION = r"^\s*([^\s:]+\.go):(\d+):\s*(.*)$"
RSPEC_SUMMARY = r"^rspec\s+(\./[^\s:]+):(\d+)\s*#\s*(.+)$"
RSPEC_BLOCK = r"^\d+\)\s+(.+)$"
RSPEC_FAILURE = r"^Failure/Error:\s*(.*)$"
RSPEC_LOCATION = r"#\s+(\./[^:\s]+):(\d+)"
CARGO_BLOCK = r"(?s)---- (\S+) stdout ----(.*?)(?=\n---- |\n\nfailures:)"
CARGO_PANIC = r"(?s)panicked at\s+'(.*?)',\s*([^\s']+):(\d+):\d+"
DOTNET_FAIL = r"^\s*Failed\s+(.+?)\s+\[\d+(?:\.\d+)?\s*m?s\]\s*$"
DOTNET_FRAME = ci(r"\sin\s+(.+?\.cs):line\s+(\d+)")

# ---- entities
_ID_VALUE = r"[A-Za-z0-9._@-]+"
_PATH_VALUE = r"/[A-Za-z0-9._/{}\[\]:?-]+"
_HTTP_METHODS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS"


def _field(names: str, value: str) -> str:
    return ci(r"(?<![A-Za-z0-9_])[\"']?(?:" + names + r")[\"']?\s*[:=]\s*[\"']?(" + value + ")")


ENTITY_FIELDS = {
    "request_id": _field("request_id|requestId|req_id|x-request-id|rid", _ID_VALUE),
    "trace_id": _field("trace_id|traceId|traceid", _ID_VALUE),
    "session_id": _field("session_id|sessionId|sid", _ID_VALUE),
    "user_id": _field("user_id|userId|username|actor|user", _ID_VALUE),
}
METHOD_FIELD = _field("method", _HTTP_METHODS) + r"\b"
PATH_FIELD = _field("path", _PATH_VALUE)
METHOD_PATH = ci(r"\b(" + _HTTP_METHODS + r")\s+(" + _PATH_VALUE + ")")

# ---- customer impact
IMPACT_OUTAGE = ci(
    r"\b(?:outage|service disruption|major incident|customer[- ]?facing|unavailable(?: to customers)?|"
    r"error budget(?: exhausted)?|sla breach)\b"
)
IMPACT_DEGRADED = ci(
    r"\b(?:degraded|partial(?:ly)?|error rate|latency|p95|p99|slow(?:ing|ed)?|intermittent|"
    r"impacted(?: customers)?)\b"
)
LOG_IMPACT_OUTAGE = ci(
    r"\b(?:outage|service disruption|major incident|customer[- ]?facing|unavailable(?: to customers)?|sla breach)\b"
)
LOG_IMPACT_NONE = ci(
    r"\b(?:no (?:customer )?impact|recovered|rollback(?:ed|ing)? (?:succeed|complete))"
)

# ---- deployment hints, group 1 is the value
DEPLOYMENT_HINTS = {
    "namespace": ci(r"(?:namespace[=/ ]| -n )([A-Za-z0-9._-]+)"),
    "target": ci(r"(?:deployment|statefulset|daemonset)/([A-Za-z0-9._-]+)"),
    "artifact": ci(r"(?:image|image:)\s*([\w./:@-]+)"),
    "revision": ci(r"(?:revision\s*(?:[=:]\s*|\s+)|version\s*[=:]\s*)([A-Za-z0-9._-]+)"),
    "previous_revision": ci(r"(?:previous_revision|prev_revision|previous revision)\s*[=:]\s*([A-Za-z0-9._-]+)"),
    "service": ci(r"(?:service[/= ])([A-Za-z0-9._-]+)"),
    "workload": ci(r"(?:workload[/= ])([A-Za-z0-9._-]+)"),
    "commit": ci(r"\b(?:commit|commit_sha|release commit)[=\s:]+([0-9a-f]{7,40})"),
    "image_digest": ci(r"\b(sha256:[0-9a-f]{64})"),
    "started_at": ci(r"(?:started_at|started at|deployment started)[=: ]\s*([0-9TZ:.\-+ ]{8,40})"),
    "finished_at": ci(r"(?:finished_at|completed_at|ended_at|finished at)[=: ]\s*([0-9TZ:.\-+ ]{8,40})"),
    "strategy": ci(r"(?:strategy|rollout strategy)[=: ]\s*([A-Za-z0-9._-]+)"),
    "migration_version": ci(r"(?:migration|schema version|migration_version)[=: ]\s*([A-Za-z0-9._-]+)"),
}
RELEASE_NAME = ci(r"(?:release|helmrelease)\s+([A-Za-z0-9._-]+)")
RELEASE_HELM = ci(r"helm\s+(?:upgrade|install)\s+(?:--install\s+)?([A-Za-z0-9._-]+)")
OUTCOME_FAILED = ci(r"\b(?:failed|error|deadline exceeded|progress deadline)\b")

# ---- advice safety
UNSAFE_ADVICE = ci(
    r"(?:\brm\s+(?:-[^\s]*r|--recursive)|\bdel(?:ete)?\s+/[sqf]|\brmdir\s+/s|"
    r"\bformat\s+[a-z]:|\bmkfs(?:\.|\s)|\bdd\s+if=|\bsudo\b|\bdoas\b|"
    r"\bkubectl\s+(?:delete|apply|replace|patch|edit|rollout\s+restart|scale)\b|"
    r"\bhelm\s+(?:install|upgrade|uninstall|rollback)\b|\bterraform\s+(?:apply|destroy)\b|"
    r"\bgit\s+(?:push|reset|clean|checkout\s+--|branch\s+-D)\b|\bdocker\s+(?:rm|rmi|system\s+prune)\b|"
    r"\b(?:curl|wget|invoke-webrequest|invoke-restmethod|nc|netcat|ssh|scp)\b|"
    r"--no-verify\b|\b(?:verify|verification|tls|ssl)\s*[:=]\s*false\b|"
    r"\b(?:disable|skip|bypass|ignore)\w*\s+(?:tls|ssl|certificate|verification|signature)\b|\bhttps?://|"
    r"\b(?:api[_ -]?key|access[_ -]?token|refresh[_ -]?token|password|secret)\s*[:=]\s*\S+)"
)

# ---- incident noise
INCIDENT_NOISE = ci(
    r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2})?(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b|"
    r"(?<=object at )0x[0-9a-fA-F]+(?=>)|/tmp/[A-Za-z0-9_./-]+|"
    r"(?<=\.[a-zA-Z]{2}):\d+(?::\d+)?|(?<=\.[a-zA-Z]{3}):\d+(?::\d+)?"
)

# ---- screens: lower-cased words of which every match of a pattern holds at least one. Looking for words is far cheaper than trying all
# alternatives at every character, and most texts hold no word of most patterns.
SCREENS = {
    TEST_MARKERS: (
        "cargo test", "go test", "make test", "npm test", "ran ", ".test", ".spec", "===== errors", "--- fail", "failed!", "failure", "test result", "total of", "junit",
        "pytest", "rspec", "running ", "test session", "testsuite:"),
    BUILD_MARKERS: (
        ".java:", "::error::", "cannot find", "compil", "could not install", "error ", "error[e", "gcc ", "go build", "importerror", "make",
        "modulenotfound", "npm run build", "tsc ", "undefined reference"),
    CI_MARKERS: ("build started", "ci/circleci", "failed", "gitlab-ci", "job ", "pipeline", "running job", "stage:", "workflow "),
    DEPLOY_MARKERS: (
        "deploy", "rollback", "rollout", "release ", "helm", "kubectl", "terraform ", "argo", " probe", "health", "imagepullbackoff", "errimagepull",
        "back-off pull", "migration ", "ecs", "cloudformation", "ansible", "pulumi", "nomad", "flux", "gcloud run", "serverless", "sls",
        "docker ", "systemctl", "crashloop", "oomkilled", "create_failed", "play recap", "allocation failed", "schedul", "quota", "image pull",
        "registry auth", "required env", "not found", "container"),
    IMPORT: ("importerror", "modulenotfound", "no module named"),
    COMPILE: (
        "[build failed]", "cannot ", "compilation error", "error ", "error:", "error[e", "no member named", "undefined reference", "undefined:"),
    TIMEOUT: ("time", "deadline"),
    GO_COUNT: ("go test",),
    JEST_FLAKY_SUMMARY: ("flaky",),
    TEST_FAIL: ("fail", "error", "exception", "assert", "panicked", "✕", "●", "×"),
    CRASH: ("panic:", "segfault", "segmentation", "sigabrt", "sigsegv"),
    IMAGE_PULL: ("back-off pull", "errimagepull", "failed to pull", "imagepullbackoff"),
    REGISTRY_AUTH: ("access denied", "authentication", "authorize", "oauth", "token exchange"),
    OOM: ("oomkilled", "out of memory", "137"),
    CRASH_LOOP: ("back-off restart", "crashloop"),
    LIVENESS: ("liveness",),
    HEALTH: ("health",),
    READINESS_PROBE: ("readiness",),
    SCHEDULING: ("nodes are available", "schedul"),
    QUOTA: ("quota", "insufficient "),
    NETWORK: ("dns", "network", "name resolution", "failed to resolve", "enotfound", "connection re", "no route to"),
    CONFIG: ("configmap", "secret", "environment variable", "configuration"),
    MIGRATION: ("migrat",),
    PERMISSION: ("denied", "forbidden", "unauthorized"),
    ROLLBACK: ("rollback", "rollout undo"),
    ROLLBACK_DONE_ANYWHERE: ("rollback", "rolled back"),
    ROLLBACK_DONE_NEAR: ("rollback", "rolled back"),
    READINESS: ("not ready", "probe failed", "crashloop", "become ready", "oomkilled"),
    DEPLOY_TIMEOUT: ("deploy", "release", "rollout", "waiting for"),
    DEPLOY_FAILURE: (
        "deploy", "release", "rollout", "terraform", "helm", "ecs", "cloudformation", "ansible", "pulumi", "nomad", "flux", "gcloud run",
        "serverless", "docker ", "systemctl", "apply failed", "create_failed", "failed=1", "allocation failed"),
    CI_FAILURE: ("fail", "exit "),
    CI_FOOTER: ("process completed",),
    DEPENDENCY: (
        "eresolve", "resolve dep", "resolutionimpossible", "conflicting dep", "dependency conflict", "resolve all files", "could not find", "poetry",
        "failed to select", "cargo"),
    DISK_FULL: ("space", "[errno 28]", "enospc", "100%", "ephemeral-storage", "disk quota"),
    TLS: ("certificate",),
    RATE_LIMIT: ("429", "rate limit", "toomanyrequests", "throttling", "retry-after"),
    GENERIC_ERROR: ("error:",),
    STRONG_ERROR: (
        "error:", "assert", "modulenotfound", "importerror", "undefined reference", "segmentation", "panic:", "no module", "npm err!"),
    CHAINED_TRACEBACK: ("above exception",),
    NPM_CODE: ("npm err!",),
    NPM_ROW: ("npm err!",),
    NPM_NOISE: ("npm err!",),
    K8S_HEADER: ("events:",),
    K8S_WARNING: ("warning",),
    PY_FRAME: ('", line ',),
    PY_FRAME_IN: (".py",),
    PY_FRAME_SHORT: (".py",),
    COMPILE_FRAME: ("error",),
    CONFIG_FRAME: (".yaml", ".yml", ".tf", ".tpl"),
    TERRAFORM_FRAME: (".yaml", ".yml", ".tf", ".tpl"),
    JAVA_FRAME: (".java",),
    CSHARP_FRAME: (".cs",),
    ENTITY_FIELDS["request_id"]: ("request_id", "requestid", "req_id", "x-request-id", "rid"),
    ENTITY_FIELDS["trace_id"]: ("trace_id", "traceid"),
    ENTITY_FIELDS["session_id"]: ("session", "sid"),
    ENTITY_FIELDS["user_id"]: ("user", "actor"),
    METHOD_FIELD: ("method",),
    METHOD_PATH: ("get", "post", "put", "delete", "patch", "head", "options"),
    IMPACT_OUTAGE: ("outage", "service disruption", "major incident", "customer", "unavailable", "error budget", "sla breach"),
    IMPACT_DEGRADED: ("degraded", "partial", "error rate", "latency", "p95", "p99", "slow", "intermittent", "impacted"),
    LOG_IMPACT_OUTAGE: ("outage", "service disruption", "major incident", "customer", "unavailable", "sla breach"),
    LOG_IMPACT_NONE: ("no ", "recovered", "rollback"),
    RELEASE_NAME: ("release",),
    RELEASE_HELM: ("helm",),
    OUTCOME_FAILED: ("failed", "error", "deadline"),
    DEPLOYMENT_HINTS["namespace"]: ("namespace", " -n "),
    DEPLOYMENT_HINTS["target"]: ("deployment", "statefulset", "daemonset"),
    DEPLOYMENT_HINTS["artifact"]: ("image",),
    DEPLOYMENT_HINTS["revision"]: ("revision", "version"),
    DEPLOYMENT_HINTS["previous_revision"]: ("previous_revision", "prev_revision", "previous revision"),
    DEPLOYMENT_HINTS["service"]: ("service",),
    DEPLOYMENT_HINTS["workload"]: ("workload",),
    DEPLOYMENT_HINTS["commit"]: ("commit",),
    DEPLOYMENT_HINTS["image_digest"]: ("sha256:",),
    DEPLOYMENT_HINTS["started_at"]: ("started",),
    DEPLOYMENT_HINTS["finished_at"]: ("finished", "completed_at", "ended_at"),
    DEPLOYMENT_HINTS["strategy"]: ("strategy",),
    DEPLOYMENT_HINTS["migration_version"]: ("migration", "schema version"),
}
