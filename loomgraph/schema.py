"""Labels, edge types and vocabularies of the code graph, and the schemas of its tables."""

from __future__ import annotations

NODE_LABELS = tuple("Annotation Author BasicBlock BuildConfig Class Cluster Commit Dependency Enum Field File Function Interface Macro Module Parameter Process SecurityFix Struct Tag TypeAlias Variable Vulnerability".split())
EDGE_TYPES = tuple(
    "AFFECTED_BY AFFECTS AUTHORED_BY BELONGS_TO BRANCHES_TO CALLS COMPILED_WITH CONTAINS DATA_FLOWS_TO DEPENDS_ON EXPANDS_MACRO FIXED_BY HAS_ANNOTATION IMPLEMENTS "
    "IMPORTS INHERITS INSTANTIATES MODIFIED_IN OVERRIDES PARENT PARTICIPATES_IN TAGGED_AS TAINTS USES_TYPE".split()
)

FLAGS = "is_input_source boolean, is_dangerous_sink boolean, is_allocator boolean, is_crypto boolean, is_parser boolean, touches_unsafe boolean, risk_score int"
NODES = f"repo string, id string, label string, seq long, name string, file string, path string, language string, line_start int, line_end int, is_exported boolean, {FLAGS}, params string, body string, extra map<string,string>"
EDGES = "repo string, src string, dst string, type string, seq long, qualifier string, resolved boolean, source string, names string, step int, lines_added int, lines_deleted int, extra map<string,string>"

#: Language -> file suffixes.
SUFFIXES = {
    "c": "c h", "cpp": "cc cpp cxx hh hpp hxx", "go": "go", "java": "java", "javascript": "cjs js jsx mjs", "kotlin": "kt kts", "objc": "m mm",
    "python": "py pyi", "rust": "rs", "swift": "swift", "typescript": "ts tsx",
}
LANGUAGE_OF = {s: lang for lang, names in SUFFIXES.items() for s in names.split()}
SKIP_DIRS = tuple(sorted("3rdparty .git .idea .loomgraph .tox .venv .vscode __pycache__ build cmake-build-debug cmake-build-release deps dist external node_modules out target third_party vendor venv".split()))
SKIP_FILES = tuple(sorted("Cargo.lock Gemfile.lock composer.lock go.sum package-lock.json poetry.lock yarn.lock".split()))

#: Name patterns of security-relevant functions; a name that contains one, in any case, has the flag.
PATTERNS = {
    "is_input_source": "Copy ReadAll ReadFile ReadFull WSARecv XMLHttpRequest accept addEventListener fetch fgets fread fscanf getHeader getInputStream getParameter getdelim getenv getline gets listen read readLine read_to_end read_to_string recv recvfrom recvmsg scanf sscanf stdin",
    "is_dangerous_sink": "Command Exec Function LoadLibrary PQexec ProcessBuilder Runtime.exec dlopen dlsym document.write eval exec execl execve execvp fprintf from_raw_parts innerHTML memcpy memmove mysql_query outerHTML popen printf snprintf sprintf sqlite3_exec strcat strcpy strncat strncpy system transmute vsnprintf vsprintf",
    "is_allocator": "Box::new ByteBuffer.allocate ByteBuffer.allocateDirect HeapAlloc HeapFree Vec::with_capacity VirtualAlloc VirtualFree alloc alloca append calloc dealloc delete free make malloc mmap munmap new realloc",
    "is_crypto": "AES_decrypt AES_encrypt Aes128 Aes256 EVP_DecryptInit EVP_DigestInit EVP_EncryptInit EVP_SignInit EVP_VerifyInit HMAC MD5 RSA_sign RSA_verify SHA1 SHA256 SHA512 Sha256 Sha512 cipher.NewGCM decrypt encrypt hash hmac hmac.New sha256.New sign verify",
    "is_parser": "JSON.parse decode deserialize flatbuffers from_bytes from_json from_xml from_yaml htmlParseDoc json.Unmarshal json.loads parse protobuf unmarshal xmlParseMemory xml_parse",
}
PATTERNS = {k: tuple(v.split()) for k, v in PATTERNS.items()}

#: Marker -> pattern; a line may carry several.
ANNOTATIONS = {
    "BUG": r"\bBUG\b", "FIXME": r"\bFIXME\b", "HACK": r"\bHACK\b", "SECURITY": r"\bSECURITY\b", "TODO": r"\bTODO\b",
    "UNSAFE": r"unsafe\s*\{|\bUNSAFE\b", "VULNERABILITY": r"\bVULN\b|\bVULNERABILITY\b", "XXX": r"\bXXX\b",
}
SECURITY_FIX = (
    r"(?i)\binformation\s+(leak|disclosure)\b|\bprivilege\s+escalation\b|\bremote\s+code\s+execution\b|\bnull[- ]pointer\b|\bout[- ]of[- ]bounds\b|\binteger[- ]overflow\b"
    r"|\bheap[- ]overflow\b|\buse[- ]after[- ]free\b|\bbuffer\s+overflow\b|\bfix\b.*\b(vuln|overflow|injection|xss|csrf|rce|dos)\b|\bsecurity\s+fix\b|\bCVE-\d{4}-\d+\b"
)
ENTRY_NAMES = {"go": ("init", "main"), "javascript": ("app", "index", "main", "server"), "typescript": ("app", "index", "main", "server")}
ENTRY_DEFAULT = ("main",)
#: Suffixes whose language counts for entry names; every other file has the default names.
ENTRY_SUFFIXES = {"c": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "go": "go", "java": "java", "js": "javascript", "kt": "kotlin", "rs": "rust", "swift": "swift", "ts": "typescript"}
OSV_ECOSYSTEM = {"Cargo.toml": "crates.io", "Package.swift": "SwiftURL", "Podfile": "CocoaPods", "conanfile.txt": "ConanCenter", "go.mod": "Go", "gradle": "Maven", "package.json": "npm"}
