"""Host, supply-chain and credential findings as rows (subject, rule, severity, detail).

The tables below are small constants that fold into the plan as expressions, so every detector is one
scan without a join.  Texts may be null: they match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kestrel.functions import scalars as S
from kestrel.operators import patterns

#: Parts of process names, with severity.
PROCESS_NAMES = [
    ("xmrig", "critical"), ("minerd", "critical"), ("cpuminer", "critical"), ("ethminer", "critical"), ("cgminer", "critical"),
    ("bfgminer", "critical"), ("nbminer", "critical"), ("t-rex", "critical"), ("phoenixminer", "critical"), ("lolminer", "critical"),
    ("kswapd0", "critical"), ("chisel", "high"), ("ngrok", "high"), ("cloudflared", "high"), ("frpc", "high"), ("bore", "high"),
    ("hydra", "critical"), ("john", "high"), ("hashcat", "high"), ("medusa", "critical"), ("nmap", "high"), ("masscan", "high"),
    ("sqlmap", "critical"), ("msfconsole", "critical"), ("msfvenom", "critical"),
]
#: Parts of command lines, with severity.
PROCESS_ARGS = [
    ("bash -i >& /dev/tcp/", "critical"), ("bash -i >& /dev/udp/", "critical"), ("/bin/sh -i", "critical"), ("nc -e /bin/", "critical"),
    ("nc -l", "high"), ("ncat -e", "critical"), ("socat exec:", "critical"), ("python -c 'import socket", "critical"),
    ("python3 -c 'import socket", "critical"), ("perl -e 'use Socket", "critical"), ("ruby -rsocket", "critical"), ("curl|bash", "critical"),
    ("curl|sh", "critical"), ("wget|bash", "critical"), ("wget|sh", "critical"), ("curl -s|bash", "critical"), ("base64 -d|bash", "critical"),
    ("base64 -d|sh", "critical"), ("base64 --decode|bash", "critical"), ("eval $(curl", "critical"), ("eval $(wget", "critical"),
    ("mimikatz", "critical"), ("lazagne", "critical"), ("linpeas", "high"), ("winpeas", "high"), ("pspy", "high"), ("--coin=", "high"),
    ("stratum+tcp://", "critical"), ("stratum+ssl://", "critical"), ("-o pool.", "high"),
]
#: Folders of short-lived files.
TEMP_FOLDERS = ["/tmp/", "/dev/shm/", "/var/tmp/"]
#: Programs that may use much CPU.
HEAVY = ["cc1", "cc1plus", "rustc", "cargo", "gcc", "g++", "clang", "node", "python", "java", "javac", "webpack", "esbuild", "ffmpeg", "blender", "make", "ninja", "cmake", "apt", "dpkg", "snap", "flatpak", "pip", "xorg", "gnome-shell", "kwin", "firefox", "chrome", "chromium", "code", "electron", "vscode"]
#: Remote ports that stand out, with severity.
REMOTE_PORTS = {
    6667: "high", 6668: "high", 6669: "high", 6697: "high", 7000: "medium", 9050: "high", 9051: "critical", 9150: "medium", 4444: "critical", 5555: "high",
    1234: "high", 31337: "critical", 12345: "high", 65535: "medium", 50050: "critical", 3333: "high", 14444: "high", 45700: "critical", 8888: "medium", 9999: "medium",
}
#: Services that should not listen on all addresses.
RISKY_LISTENERS = {
    3306: "MySQL", 5432: "PostgreSQL", 6379: "Redis", 27017: "MongoDB", 11211: "Memcached", 9200: "Elasticsearch", 5601: "Kibana", 8080: "HTTP proxy/dev server",
    2375: "Docker API (unencrypted!)", 2376: "Docker API", 5900: "VNC", 5901: "VNC", 1433: "MSSQL", 1521: "Oracle DB", 9042: "Cassandra", 7474: "Neo4j",
    15672: "RabbitMQ Management", 8500: "Consul", 2181: "Zookeeper",
}
#: Parts of scheduled commands, with severity.
SCHEDULED = [
    ("curl|bash", "critical"), ("curl|sh", "critical"), ("wget|bash", "critical"), ("wget|sh", "critical"), ("curl -s|", "critical"), ("base64 -d", "critical"),
    ("base64 --decode", "critical"), ("eval $(", "critical"), ("python -c", "high"), ("python3 -c", "high"), ("nc -e", "critical"), ("ncat -e", "critical"),
    ("/dev/tcp/", "critical"), ("stratum+tcp://", "critical"), ("stratum+ssl://", "critical"), ("xmrig", "critical"), ("minerd", "critical"), ("/tmp/.", "high"), ("/dev/shm/", "high"),
]
#: Shapes of vendor credentials, first match first.
CREDENTIALS = [
    ("AWS Access Key", "AKIA[0-9A-Z]{16}"),
    ("GitHub Token", "gh[pousr]_[A-Za-z0-9_]{36,}"),
    ("Anthropic API Key", r"sk-ant-[A-Za-z0-9_\-]{40,}"),
    ("OpenAI API Key", "sk-[A-Za-z0-9]{40,}"),
    ("Stripe Key", "[sr]k_live_[A-Za-z0-9]{20,}"),
    ("Slack Token", r"xox[bporas]-[A-Za-z0-9\-]{10,}"),
    ("Database URL with creds", "(postgres|mysql|mongodb)://[^:]+:[^@]+@"),
]
#: What every text with such a credential holds.
CREDENTIAL_NEEDS = {
    "AWS Access Key": ("AKIA",), "GitHub Token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "Anthropic API Key": ("sk-ant-",), "OpenAI API Key": ("sk-",),
    "Stripe Key": ("sk_live_", "rk_live_"), "Slack Token": ("xox",), "Database URL with creds": ("postgres://", "mysql://", "mongodb://"),
}
#: Addresses and commands that lock files should not hold.
LOCK_ADDRESSES = ["pastebin.com", "bit.ly", "tinyurl.com", "ngrok.io", "serveo.net", "localhost:", "127.0.0.1", "0.0.0.0"]
LOCK_COMMANDS = ["curl ", "wget ", "powershell ", "child_process", "net.connect", "/dev/tcp/", "base64 -d", "base64 --decode"]
JS_LOCKS = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml"]
PYTHON_LOCKS = ["Pipfile.lock", "poetry.lock"]
#: Hooks that run by themselves, and commands that they should not hold.
HOOKS = ["pre-commit", "post-commit", "pre-push", "post-checkout", "post-merge", "pre-rebase"]
HOOK_COMMANDS = ["curl ", "wget ", "nc ", "ncat ", "netcat ", "base64", "/dev/tcp/", "python -c", "python3 -c", "powershell", "cmd /c", "| sh", "| bash", "| zsh", "chmod +x /tmp", "chmod 777"]
#: Names of files that hold secrets, and parts of names of their templates.
SENSITIVE_NAMES = [".env", "credentials", "credentials.json", "secrets.json", "htpasswd", "shadow", "auth.json", "service_account.json", ".netrc", ".pgpass", ".my.cnf"]
SENSITIVE_ENDINGS = [".pem", ".key", ".pfx", ".p12", ".keystore", ".jks"]
SENSITIVE_STARTS = [".env.", "id_rsa", "id_ed25519", "id_ecdsa", "id_dsa", "api_key", "apikey"]
TEMPLATES = [".example", ".sample", ".template", ".dist"]
#: Commands that install scripts should not hold.
INSTALL_COMMANDS = ["curl", "wget", "eval", "exec", "child_process", "http.get", "net.connect"]
INSTALL_SCRIPTS = ["postinstall", "preinstall", "prepare"]
#: Popular packages, in the order of the decision, and known malicious ones.
POPULAR_PYTHON = [
    "requests", "django", "flask", "numpy", "pandas", "tensorflow", "pytorch", "boto3", "pillow", "cryptography", "paramiko", "sqlalchemy", "celery",
    "redis", "psycopg2", "aiohttp", "fastapi", "pydantic", "scrapy", "beautifulsoup4", "selenium", "matplotlib", "scipy", "scikit-learn",
    "httpx", "uvicorn", "gunicorn", "alembic", "black", "mypy", "pytest", "setuptools", "pip", "wheel", "docker", "kubernetes", "anthropic",
    "openai", "langchain", "transformers", "torch", "pyyaml", "jinja2", "click", "attrs", "marshmallow", "arrow", "pendulum", "rich", "typer", "loguru", "tenacity",
]
POPULAR_NPM = [
    "react", "express", "lodash", "axios", "webpack", "next", "vue", "angular", "typescript", "eslint", "prettier", "jest", "mocha", "chalk", "commander",
    "dotenv", "cors", "mongoose", "sequelize", "prisma", "socket.io", "tailwindcss", "vite", "esbuild", "rollup", "postcss", "sass", "nodemon", "babel", "webpack-cli",
]
MALICIOUS_PYTHON = ["colourama", "python-binance", "python3-dateutil", "jeIlyfish", "python-mongo", "pymongodb", "requesocks", "requesrs", "python-ftp", "beautifulsup4", "djanga", "djnago", "numppy", "pandaas", "urlib3", "urllib", "flaskk"]
MALICIOUS_NPM = [
    "crossenv", "cross-env.js", "d3.js", "fabric-js", "ffmepg", "gruntcli", "http-proxy.js", "jquery.js", "mariadb", "mongose", "mssql.js", "mssql-node",
    "mysqljs", "nodecaffe", "nodefabric", "nodeffmpeg", "nodemailer-js", "nodemssql", "node-openssl", "noderequest", "nodesass", "nodesqlite", "node-tkinter",
    "opencv.js", "openssl.js", "proxy.js", "shadowsock", "smb", "sqlite.js", "sqliter", "sqlserver",
]


def _hit(rule: str, severity: str | Column, detail: str | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(F.lit(rule).alias("rule"), lit(severity).alias("severity"), lit(detail).alias("detail"))


def _first(text: Column, table: list[tuple[str, str]], rule: str) -> Column:
    """The first entry that the text contains, null without one."""
    hits = F.array(*(_hit(rule, severity, part) for part, severity in table))  # folds into one constant
    return F.get(F.filter(hits, lambda hit: text.contains(hit["detail"])), F.lit(0))


def _each(text: Column, parts: list[str], rule: str, severity: str) -> list[Column]:
    """Every entry that the text contains."""
    return [F.when(text.contains(p), _hit(rule, severity, p)) for p in parts]


def _any(text: Column, parts: list[str], how: str = "contains") -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda part: getattr(text, how)(part))


def _lookup(key: Column, table: dict) -> Column:
    """The table's value, null for other keys."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _rows(df: DataFrame, subject: str, hits: list[Column]) -> DataFrame:
    found = df.select(F.col(subject).alias("subject"), F.explode(F.array_compact(F.array(*hits))).alias("hit"))
    return found.select("subject", "hit.rule", "hit.severity", "hit.detail")


def processes(df: DataFrame) -> DataFrame:
    """Findings on (pid, name, cmdline, exe, cpu, run_seconds).

    One row per table at most (Q8).  An empty command line marks a kernel thread: its name is not judged.
    """
    df = df.withColumn("_low", F.lower("name"))
    name, cmd, cpu = F.col("_low"), F.col("cmdline"), F.col("cpu")
    busy = (cpu > 50) & (F.col("run_seconds") > 60) & ~_any(name, HEAVY)
    return _rows(
        df,
        "pid",
        [
            F.when(cmd != "", _first(name, PROCESS_NAMES, "process.name")),
            _first(cmd, PROCESS_ARGS, "process.args"),
            F.when(busy, _hit("process.cpu", F.when(cpu > 90, "high").otherwise("medium"), F.col("name"))),
            F.when(_any(F.col("exe"), TEMP_FOLDERS, "startswith"), _hit("process.temp_exe", "critical", F.col("exe"))),
        ],
    )


def sockets(lines: DataFrame, line: str = "value") -> DataFrame:
    """(local_ip, local_port, remote_ip, remote_port, state) of /proc/net/tcp and tcp6 lines; headings and others go."""
    part = F.col("part")
    fields = F.struct(S.hex_address(F.get(part, F.lit(1))).alias("l"), S.hex_address(F.get(part, F.lit(2))).alias("r"), F.upper(F.get(part, F.lit(3))).alias("state"))
    # Unnested, so that what follows reads the fields of addresses that were parsed once.
    parsed = lines.select(F.split(F.trim(line), r"\s+").alias("part")).select(F.inline(F.array(fields)))
    return parsed.where("l is not null and r is not null").select(*(F.col(f"{a}.{b}").alias(f"{n}_{b}") for a, n in (("l", "local"), ("r", "remote")) for b in ("ip", "port")), "state")


def connections(df: DataFrame) -> DataFrame:
    """Established connections to ports that stand out, an endpoint once, and risky services on all addresses."""
    severity = _lookup(F.col("remote_port").cast("int"), REMOTE_PORTS)
    out = df.where((F.col("state") == "01") & ~S.is_private_ip(F.col("remote_ip"))).where(severity.isNotNull())
    out = out.select(F.concat_ws(":", "remote_ip", "remote_port").alias("subject"), F.lit("network.remote_port").alias("rule"), severity.alias("severity"), F.col("remote_port").cast("string").alias("detail"))
    service = _lookup(F.col("local_port").cast("int"), RISKY_LISTENERS)
    listening = df.where((F.col("state") == "0A") & (F.col("local_ip") == "0.0.0.0")).where(service.isNotNull())
    listening = listening.select(F.concat_ws(":", "local_ip", "local_port").alias("subject"), F.lit("network.listener").alias("rule"), F.lit("high").alias("severity"), service.alias("detail"))
    return out.unionByName(listening).distinct()


def socket_owners(sockets: DataFrame, links: DataFrame, processes: DataFrame) -> DataFrame:
    """Sockets of an inode with the name of the (pid, inode) link's process, null where none is known."""
    named = links.select(F.col("pid").alias("_pid"), "inode").join(processes.select(F.col("pid").alias("_pid"), F.col("name").alias("process")), "_pid")
    return sockets.join(named.groupBy("inode").agg(F.min("process").alias("process")), "inode", "left")


def scheduled(df: DataFrame, key: str = "source", command: str = "command") -> DataFrame:
    """The first table entry in each scheduled command."""
    return _rows(df, key, [_first(F.col(command), SCHEDULED, "scheduled.command")])


def credentials(df: DataFrame, key: str, text: str, more: list[tuple | patterns.Pattern] = ()) -> DataFrame:
    """The first vendor credential in each text, or else of more (name, pattern) shapes."""
    table = [*(patterns.Pattern(n, p, CREDENTIAL_NEEDS[n]) for n, p in CREDENTIALS), *more]
    name = patterns.first_match(F.col(text), table)
    found = df.select(F.col(key).alias("subject"), name.alias("detail")).where("detail is not null")
    return found.select("subject", F.lit("credential").alias("rule"), F.lit("high").alias("severity"), "detail")


def lock_files(files: DataFrame) -> DataFrame:
    """Addresses, commands and plain HTTP in lock files of (path, content); vendored and hidden folders go."""
    name, text = S.basename(F.col("path")), F.col("content")
    js = name.isin(JS_LOCKS)
    seen = files.where(name.isin(JS_LOCKS + PYTHON_LOCKS) & ~F.col("path").rlike("(^|/)(node_modules|__pycache__|[.][^/]*)/") & (S.depth(F.col("path")) < 4))
    hits = _each(text, LOCK_ADDRESSES, "supply.address", "high")
    hits += [F.when(js, h) for h in _each(text, LOCK_COMMANDS, "supply.command", "critical")]
    return _rows(seen, "path", [*hits, F.when(js & text.contains('"resolved": "http://'), _hit("supply.plain_http", "high", "http://"))])


def git_hooks(files: DataFrame) -> DataFrame:
    """The first suspicious command of a hook, and download-and-run pairs."""
    text = F.col("content")
    seen = files.where(F.col("path").rlike(f"(^|/)[.]git/hooks/({'|'.join(HOOKS)})[^/]*$") & ~F.col("path").endswith(".sample"))
    fetch = (text.contains("curl") | text.contains("wget")) & (text.contains("| sh") | text.contains("| bash"))
    return _rows(seen, "path", [_first(F.lower(text), [(c, "critical") for c in HOOK_COMMANDS], "hook.command"), F.when(fetch, _hit("hook.download_run", "critical", "download and run"))])


def is_sensitive(name: Column) -> Column:
    """Names of files that hold secrets, without their templates."""
    low = F.lower(name)
    return (low.isin(SENSITIVE_NAMES) | _any(low, SENSITIVE_ENDINGS, "endswith") | _any(low, SENSITIVE_STARTS, "startswith")) & ~_any(low, TEMPLATES)


def permissions(meta: DataFrame) -> DataFrame:
    """Sensitive files of (path, mode) that others may write (high) or read (medium)."""
    writable, readable = S.has_bits(F.col("mode"), 0o002), S.has_bits(F.col("mode"), 0o004)
    mode = F.conv(F.col("mode").cast("long").bitwiseAND(F.lit(0o777).cast("long")).cast("string"), 10, 8)
    seen = meta.where(is_sensitive(S.basename(F.col("path"))))
    return _rows(seen, "path", [F.when(writable | readable, _hit("file.permissions", F.when(writable, "high").otherwise("medium"), mode))])


def odd_files(meta: DataFrame, hours: int = 24) -> DataFrame:
    """Set-user-id files outside the system's folders, and executables of the last hours in folders of short-lived files, of (path, mode, age_hours)."""
    path, mode = F.col("path"), F.col("mode")
    name = S.basename(path)
    system = path.rlike("^/(usr|bin|sbin|lib|lib64|opt|snap)/")
    suid = F.when(S.has_bits(mode, 0o4000) & ~system, _hit("file.suid", "high", name))
    fresh = F.when(_any(path, TEMP_FOLDERS, "startswith") & S.has_bits(mode, 0o111) & (F.col("age_hours") < hours), _hit("file.temp_executable", "medium", name))
    return _rows(meta, "path", [suid, fresh])


def autostart(files: DataFrame) -> DataFrame:
    """Findings on (path, content) of shell start files, units and desktop entries.

    The first scheduled-command entry, PATH folders for short-lived files, a start from one, and entries
    that are both hidden and not displayed.
    """
    text = F.col("content")
    on_path = F.regexp_extract(text, r"(?m)^\s*(?:export\s+)?PATH=[\"']?(?:[^\n\"']*:)?((?:/tmp|/dev/shm|/var/tmp)[^:\n\"']*)", 1)
    starts = F.regexp_extract(text, r"(?m)^\s*Exec(?:Start)?=((?:/tmp|/dev/shm|/var/tmp)/\S*)", 1)
    unseen = text.rlike(r"(?mi)^\s*Hidden\s*=\s*true") & text.rlike(r"(?mi)^\s*NoDisplay\s*=\s*true")
    elsewhere = (on_path == "") & (starts == "")
    return _rows(
        files,
        "path",
        [
            F.when(elsewhere, _first(text, SCHEDULED, "autostart.command")),
            F.when(on_path != "", _hit("autostart.path", "high", on_path)),
            F.when(starts != "", _hit("autostart.temp_exec", "critical", starts)),
            F.when(unseen, _hit("autostart.hidden", "medium", "Hidden and NoDisplay")),
        ],
    )


def containers(df: DataFrame) -> DataFrame:
    """Risky settings of (name, privileged, binds, network_mode, user, image) (D54); a row for each socket mount."""
    image = F.coalesce("image", F.lit(""))
    plain = [
        F.when(F.col("privileged"), _hit("container.privileged", "critical", "privileged")),
        F.when(F.col("network_mode") == "host", _hit("container.host_network", "high", "host")),
        F.when(F.coalesce("user", F.lit("")) == "", _hit("container.root", "high", "no user")),
        F.when(image.endswith(":latest") | ~image.contains(":"), _hit("container.latest", "medium", image)),
    ]
    mounts = df.select("name", F.explode("binds").alias("bind")).where(F.col("bind").contains("docker.sock"))
    return _rows(df, "name", plain).unionByName(_rows(mounts, "name", [_hit("container.socket", "critical", F.col("bind"))]))


def escapes(df: DataFrame) -> DataFrame:
    """Container processes of (pid, status, cgroup) with CAP_SYS_ADMIN, bit 21."""
    caps = S.hex_number(F.regexp_extract("status", r"(?m)^CapEff:\s*([0-9a-fA-F]+)", 1))
    inside = F.col("cgroup").contains("docker") | F.col("cgroup").contains("containerd")
    return _rows(df.where(inside & S.has_bits(caps, 1 << 21)), "pid", [_hit("container.sys_admin", "critical", F.regexp_extract("status", r"(?m)^CapEff:\s*([0-9a-fA-F]+)", 1))])


def tracked_env(paths: DataFrame) -> DataFrame:
    """Environment files among tracked (path) rows, their templates included."""
    name = S.basename(F.col("path"))
    return _rows(paths.where(name.startswith(".env")), "path", [_hit("git.env_tracked", "critical", name)])


def is_typosquat(name: Column, popular: list[str]) -> Column:
    """Order decides (Q6): the first popular name that is equal (no) or two edits or fewer away (yes); short names never."""
    low = F.lower(name)
    out = F.when(F.length(name) <= 3, False)
    for p in popular:
        out = out.when(low == p, False).when(F.levenshtein(low, F.lit(p), 2).between(1, 2), True)
    return out.otherwise(False)


def _deletions(word: Column, most: int) -> Column:
    """The words that up to `most` deletions leave of a word, itself included."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = last = F.array(word)
    for _ in range(most):
        last = F.array_distinct(F.flatten(F.transform(last, lambda w: F.when(F.length(w) > 0, without(w)).otherwise(F.array()))))
        out = F.concat(out, last)
    return F.array_distinct(out)


def typosquats(names: DataFrame, popular: DataFrame, edits: int = 2) -> DataFrame:
    """Distinct names with the popular name that decides, and whether they squat on it (J15, X6, D57, Q6): the decisions of is_typosquat for lists of any length.

    names (name), popular (name, position).  Words within `edits` of one another share a word that as many
    deletions leave of each, so names meet popular ones by equality on those, and only what meets is
    measured.  Of the popular names that are near the first by position decides: the same one (no) or
    another (yes).  Short names never squat and have no row, nor have those that are near none.
    """
    low = names.where(F.length("name") > 3).select("name", F.lower("name").alias("low")).distinct()
    words = low.select("low").distinct().select("low", F.explode(_deletions(F.col("low"), edits)).alias("left"))
    # A popular name that stands there twice counts at its first position.
    known = popular.groupBy(F.lower("name").alias("popular")).agg(F.min("position").alias("position"))
    known = known.select("popular", "position", F.explode(_deletions(F.col("popular"), edits)).alias("left"))
    met = words.join(known, "left").select("low", "popular", "position").distinct()
    near = met.withColumn("distance", F.levenshtein("low", "popular")).where(F.col("distance") <= edits)
    first = near.groupBy("low").agg(F.min(F.struct("position", "popular", "distance")).alias("p"))
    return low.join(first, "low").select("name", F.col("p.popular").alias("popular"), (F.col("p.distance") > 0).alias("squats"))


def packages(df: DataFrame, key: str = "path", name: str = "package", ecosystem: str = "ecosystem") -> DataFrame:
    """Known malicious packages, else near namesakes of popular ones, of (path, package, ecosystem)."""
    hits = []
    for eco, bad, popular in (("python", MALICIOUS_PYTHON, POPULAR_PYTHON), ("npm", MALICIOUS_NPM, POPULAR_NPM)):
        known = F.lower(name).isin([b.lower() for b in bad])
        hit = F.when(known, _hit("package.malicious", "critical", F.col(name))).when(is_typosquat(F.col(name), popular), _hit("package.typosquat", "high", F.col(name)))
        hits.append(F.when(F.col(ecosystem) == eco, hit))
    return _rows(df, key, hits)


def install_scripts(files: DataFrame) -> DataFrame:
    """Install scripts of package.json files of (path, content) that fetch or run code; the first command of each."""
    seen = files.where((S.basename(F.col("path")) == "package.json") & ~F.col("path").rlike("(^|/)node_modules/"))
    hits = [_first(F.get_json_object("content", f"$.scripts.{s}"), [(c, "critical") for c in INSTALL_COMMANDS], f"package.{s}") for s in INSTALL_SCRIPTS]
    return _rows(seen, "path", hits)


def obfuscated(files: DataFrame) -> DataFrame:
    """Scripts of (path, content) with over 1000 characters in fewer than 5 line ends (D60); bundles included."""
    text = F.col("content")
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return _rows(files.where(S.extension(F.col("path")) == "js"), "path", [F.when((F.length(text) > 1000) & (ends < 5), _hit("repo.obfuscated", "high", S.basename(F.col("path"))))])


def container_alerts(df: DataFrame, cpu: float = 80.0, ram: float = 85.0, only_failed: bool = False) -> DataFrame:
    """Alerts on container samples (D61): exits (with `only_failed` those of a non-zero code, Q24); the rest if running."""
    running, failed = F.col("status") == "running", F.col("status") == "exited"
    failed = failed & (F.col("exit_code") != 0) if only_failed else failed
    share = F.when(F.col("mem_limit") > 0, F.col("mem_usage") * 100.0 / F.col("mem_limit"))
    return _rows(
        df,
        "name",
        [
            F.when(failed, _hit("container.exited", "critical", F.col("exit_code").cast("string"))),
            F.when(running & (F.col("cpu_percent") > cpu), _hit("container.cpu", "warning", F.format_string("%.1f", "cpu_percent"))),
            F.when(running & (share > ram), _hit("container.ram", "critical", F.format_string("%.1f", share))),
            F.when(running & (F.col("health") == "unhealthy"), _hit("container.unhealthy", "warning", "unhealthy")),
            F.when(running & (F.col("restart_count") >= 3), _hit("container.restarts", "critical", F.col("restart_count").cast("string"))),
        ],
    )


def usage_alerts(daily: DataFrame, key: str, tokens: str, warning: int = 800_000, critical: int = 2_000_000) -> DataFrame:
    """Both alerts fire above the higher threshold."""
    return _rows(daily, key, [F.when(F.col(tokens) > n, _hit("usage", s, F.col(tokens).cast("string"))) for s, n in (("warning", warning), ("critical", critical))])


def port_conflicts(df: DataFrame) -> DataFrame:
    """Ports that more than one row listens on: (port, listeners)."""
    return df.groupBy("port").agg(F.count("*").alias("listeners")).where("listeners > 1")
