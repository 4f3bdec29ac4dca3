"""Word lists, lookup tables, weights and patterns that decide results.

They are data, not logic: changing one changes what an operator reports.
"""

# --- Fixed values: business vocabularies -------------------------------------
BUSINESS_TERMS = [
    "patient", "eligibility", "commercial", "medicaid", "medicare",
    "payer", "claim", "member", "account", "provider", "hospital",
    "coverage", "enrollment", "benefit", "policy", "premium",
    "bdf", "prebdf", "postbdf", "gmrn", "mrn", "lead", "family",
    "demographic", "address", "phone", "ssn", "dob", "gender",
    "ack", "acknowledgment", "swift", "edi", "270", "271",
]
DOMAIN_KEYWORDS = [
    "customer", "account", "transaction", "payment", "order",
    "product", "inventory", "sales", "finance", "billing",
    "claims", "policy", "member", "patient", "provider",
    "enrollment", "eligibility", "demographics", "address",
]
FUNCTION_KEYWORDS = [
    "lead", "coverage", "gmrn", "patient", "cdd", "edi", "demographics", "matching",
]
CRITICAL_TERMS = ["patient", "eligibility", "commercial", "medicaid"]
REPOSITORY_DOMAINS = {
    "cdd": "CDD (Coverage Data Discovery)",
    "gmrn": "GMRN",
    "lead": "Lead Generation",
    "patient": "Patient Matching",
}

# --- Fixed values: file kinds -------------------------------------------------
SYSTEM_EXTENSIONS = {
    "hadoop": [".pig", ".hql", ".xml", ".sh", ".py", ".properties", ".sql"],
    "abinitio": [".mp", ".dml", ".ksh", ".sh", ".pl"],
    "databricks": [".py", ".sql", ".scala", ".ipynb", ".sh"],
}
DEFAULT_EXTENSIONS = [".sh", ".py", ".sql"]
SKIP_FOLDERS = [".git", "__pycache__", "target", "build"]
BACKUP_SUFFIXES = [".bak", ".tmp", ".backup", "~"]
SCRIPT_TYPES = {
    "py": "PySpark", "pig": "Pig", "sh": "Shell", "sql": "Hive", "hql": "Hive", "jar": "Java",
}
PROJECT_INDICATORS = ["mp", "dml", "components", "pset", "plan"]
PROJECT_SKIP_PREFIXES = ["__", ".", "tmp", "temp", "backup", "archive"]

# --- Fixed values: job files ----------------------------------------------------
JIL_KEYWORDS = [
    "insert_job:", "update_job:", "delete_job:",
    "job_type:", "command:", "machine:", "condition:",
    "owner:", "permission:", "date_conditions:", "box_name:",
]
CONDITION_CODES = {
    "s": "success", "f": "failure", "d": "done", "r": "running",
    "n": "notrunning", "t": "terminated", "p": "pending",
}

# --- Fixed values: workflow XML -------------------------------------------------
ACTION_TYPES = ["spark", "hive", "pig", "sqoop", "shell", "java", "map-reduce", "sub-workflow"]
SUBWORKFLOW_KEYS = [
    "table", "tableName", "dataset", "datasetName", "source", "target",
    "inputTable", "outputTable", "sourceTable", "targetTable",
]
WORKFLOW_SCRIPT_SUFFIXES = [".py", ".pig", ".sh", ".sql", ".hql", ".jar"]
HDFS_SKIP_SEGMENTS = ["warehouse", "user", "tmp", "stage", "staging", "temp", "hdfs", "nameservice"]

# --- Fixed values: type maps ----------------------------------------------------
ACTION_TO_COMPONENT = {
    "spark": "Spark_Job", "hive": "Hive_Query", "pig": "Pig_Script",
    "sqoop": "Sqoop_Import", "shell": "Shell_Script",
    "sub-workflow": "Oozie_Workflow", "coordinator": "Oozie_Coordinator",
    "java": "Spark_Job", "map-reduce": "Spark_Job",
}
GRAPH_TO_COMPONENT = {
    "Input_File": "Input_File", "Output_File": "Output_File", "Lookup_File": "Lookup_File",
    "Transform": "Transform", "Reformat": "Transform", "Join": "Join", "Filter": "Filter",
    "Aggregate": "Aggregate", "Rollup": "Aggregate", "Sort": "Sort", "Dedup": "Filter",
    "Gather": "Aggregate", "Partition": "Filter", "Scan": "Input_File",
    "Run_Program": "Transform",
}
GRAPH_TO_ACTION = {
    "Input_File": "input", "Output_File": "output", "Transform": "transform",
    "Reformat": "transform", "Join": "join", "Filter": "filter", "Aggregate": "aggregate",
    "Rollup": "aggregate", "Sort": "sort", "Lookup_File": "lookup",
}
GRAPH_COMPONENT_TYPES = list(GRAPH_TO_COMPONENT)
GRAPH_DATATYPES = {
    "decimal": "decimal", "string": "string", "integer": "integer", "date": "date",
    "datetime": "timestamp", "real": "float",
}
HIVE_DATATYPES = {
    "string": "string", "int": "integer", "bigint": "integer", "double": "double",
    "float": "float", "boolean": "boolean", "date": "date", "timestamp": "timestamp",
    "binary": "binary", "array": "array", "struct": "struct", "map": "map",
}

# --- Fixed values: words used by extraction rules --------------------------------
FROM_RESERVED = ["SELECT", "WHERE", "GROUP"]
PREDICATE_WORDS = ["AND", "OR", "NOT", "IS", "NULL", "TRUE", "FALSE", "IN", "LIKE", "BETWEEN"]
AGGREGATE_WORDS = ["SUM", "COUNT", "AVG", "MAX", "MIN"]
NOTEBOOK_OPERATIONS = [
    "filter", "select", "groupBy", "agg", "join",
    "union", "distinct", "drop", "withColumn",
    "repartition", "coalesce", "cache", "persist",
]
QUALITY_WORDS = [
    "is not null", "is null", "not null",
    "length", "len(",
    "valid", "invalid",
    "check", "validate",
    "between", "in (",
    "regexp", "regex", "matches",
]
LEVEL_WORDS = {"account": ["patient", "account"], "person": ["person"]}

# --- Fixed values: questions ------------------------------------------------------
TERM_CORRECTIONS = {
    "abinito": "abinitio", "ab initio": "abinitio", "hadop": "hadoop",
    "sparc": "spark", "autosys": "autosys", "databrick": "databricks",
}
QUESTION_SYSTEMS = {
    "abinitio": r"(?i)\b(ab ?initio|\.mp|\.dml|graph|component)\b",
    "hadoop": r"(?i)\b(hadoop|hive|pig|\.hql|\.pig|mapreduce)\b",
    "databricks": r"(?i)\b(databricks|spark|pyspark|notebook|\.py|\.ipynb)\b",
}
COMPARISON_WORDS = [
    "compare", "difference", "versus", "vs", "similar", "equivalent",
    "match", "both", "between", "across", "different", "same",
]
LINEAGE_WORDS = [
    "lineage", "trace", "track", "flow", "source", "target", "derive",
    "origin", "upstream", "downstream", "dependency", "column", "field",
]
# Ordered overrides: (intent, confidence, phrases). The multi-system comparison rule
# sits between the second and the third of them.
INTENT_OVERRIDES = [
    ("document_generation", 0.98,
     ["generate document", "generate sttm", "create document", "export", "generate report"]),
    ("workflow_mapping", 0.96,
     ["replaced", "what replaced", "n:1", "1:n", "unmapped", "migration", "consolidation"]),
    ("lineage", 0.90, ["lineage", "trace", "source", "target", "derive"]),
    ("logic_analysis", 0.85, ["how does", "explain", "logic", "transformation"]),
    ("code_search", 0.80, ["find", "search", "locate", "show me", "list all"]),
]
INTENT_PATTERNS = {
    "comparison": [
        r"(?i)\b(compare|difference|versus|vs|similar|equivalent|match)\b",
        r"(?i)\b(both|between|across)\b.*\b(system|graph|workflow|pipeline)\b",
        r"(?i)\b(hadoop|databricks|abinitio).*\b(and|vs|versus)\b.*\b(hadoop|databricks|abinitio)\b",
    ],
    "lineage": [
        r"(?i)\b(lineage|trace|track|flow|source|target|derive|origin)\b",
        r"(?i)\b(column|field).*\b(come from|source|derived|calculated)\b",
        r"(?i)\b(upstream|downstream|dependency|dependent)\b",
        r"(?i)\b(STTM|mapping|source.*target)\b",
    ],
    "logic_analysis": [
        r"(?i)\b(logic|transformation|calculate|compute|process)\b",
        r"(?i)\b(how does|what does|explain|understand)\b.*\b(work|process|transform)\b",
        r"(?i)\b(business rule|rule|validation|check)\b",
        r"(?i)\b(aggregate|join|filter|group)\b",
    ],
    "code_search": [
        r"(?i)\b(find|search|locate|show me|where is)\b.*\b(code|function|component|graph)\b",
        r"(?i)\b(contains|uses|calls|references)\b",
        r"(?i)\b(all|list).*\b(graph|workflow|component|table)\b",
    ],
    "document_generation": [
        r"(?i)\b(generate|create|export|produce|build)\b.*\b(document|doc|report|sheet|excel|sttm|mapping)\b",
        r"(?i)\b(generate|create).*\b(comparison|sttm|mapping)\b",
        r"(?i)\b(document|export)\b.*\b(for|about)\b.*\b(flow|workflow|pipeline)\b",
    ],
    "workflow_mapping": [
        r"(?i)\b(replaced|migration|unmapped|gap|mapping)\b.*\b(workflow|pipeline|flow)\b",
        r"(?i)\b(what.*replaced|which.*replaced)\b",
        r"(?i)\b(n:1|1:n|n-1|1-n|consolidation|split|merged|combined)\b",
        r"(?i)\b(show|list|find).*\b(mapping|unmapped)\b",
    ],
}
QUESTION_ENTITY_PATTERNS = [
    r"[\"']([^\"']+)[\"']",
    r"\b([A-Z][a-zA-Z0-9_]*|[a-z]+_[a-z0-9_]+)\b",
    r"(?i)\bgraph\s+(\w+)", r"(?i)\btable\s+(\w+)", r"(?i)\bfield\s+(\w+)",
    r"(?i)\bcolumn\s+(\w+)", r"(?i)\bcomponent\s+(\w+)", r"(?i)\bworkflow\s+(\w+)",
]

# --- Fixed values: sheet and JSON detection --------------------------------------
COMPARISON_SHEET_WORDS = ["comparison", "compare", "vs"]
COMPARISON_COLUMN_WORDS = ["hadoop", "databricks", "abinitio", "source", "target"]
MAPPING_SHEET_WORDS = ["mapping", "map", "correlation"]
STTM_SHEET_WORDS = ["sttm", "source to target", "s2t"]

# --- Fixed values: references from one script to another --------------------------
FILE_REFERENCE_PATTERNS = [
    r"source\s+([^\s;]+\.sh)",
    r"\./([^\s;]+\.sh)",
    r"bash\s+([^\s;]+\.sh)",
    r"sh\s+([^\s;]+\.sh)",
    r"python\s+([^\s;]+\.py)",
    r"pig\s+-f\s+([^\s;]+\.pig)",
    r"hive\s+-f\s+([^\s;]+\.hql)",
    r"spark-submit\s+([^\s;]+\.py)",
    r'"([^"]+\.(?:sh|py|pig|hql|sql))"',
    r"'([^']+\.(?:sh|py|pig|hql|sql))'",
]
# Graph name inside a job command, in order of priority.
GRAPH_COMMAND_PATTERNS = [
    r"runpset\.ksh\s+-P\s+([a-zA-Z0-9_\-]+)\.pset",
    r"([a-zA-Z0-9_\-/]+)\.pset",
    r"([a-zA-Z0-9_\-/]+\.mp)",
    r"([a-zA-Z0-9_\-/]+\.plan)",
    r"air\s+sandbox\s+run\s+([a-zA-Z0-9_\-/]+)",
    r"(?i)graph[=\s]+([a-zA-Z0-9_\-]+)",
]

# --- Fixed values: weights and thresholds ------------------------------------------
PROCESS_WEIGHTS = {"name": 0.2, "tables": 0.4, "domain": 0.2, "components": 0.2}
PROCESS_THRESHOLD = 0.7
PAIR_WEIGHTS = {"data": 0.5, "logic": 0.3, "business": 0.2}
PAIR_THRESHOLD = 0.3
LOGIC_WEIGHTS = {"transformations": 0.4, "tables": 0.3, "rules": 0.3}
SEVERITIES = ["critical", "high", "medium", "low"]
