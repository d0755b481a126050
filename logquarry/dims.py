"""Word lists, patterns, thresholds and advice texts.

Everything here is data that results depend on. It is written out plainly so that a
reader can compare it with the requirements; nothing is computed.
"""

# Service types, tested in this order.
SERVICE_TYPES = ["nova-api", "nova-compute", "nova-scheduler"]

# Words whose presence becomes a has_<word> feature.
ERROR_WORDS = ["error", "failed", "exception", "timeout", "denied", "rejected"]

# Words whose presence becomes a mentions_<word> feature.
RESOURCE_WORDS = ["instance", "server", "image", "network", "volume", "flavor"]

# Words that make a line important.
IMPORTANT_WORDS = [
    "error", "critical", "failed", "exception", "timeout",
    "connection_lost", "unavailable", "denied", "rejected",
    "spawning", "terminating", "destroyed", "claim", "resource",
    "attempting", "successful", "instance", "vm", "hypervisor",
]

# Phrases of critical lines.
CRITICAL_PHRASES = [
    "no valid host", "connection failed", "timeout", "denied", "rejected",
    "insufficient", "quota exceeded", "disk full", "memory exhausted",
    "instance failed", "spawn failed", "termination failed",
]

# Phrases of life-cycle lines.
LIFECYCLE_PHRASES = [
    "spawning", "terminating", "destroyed", "instance spawned",
    "instance destroyed", "vm started", "vm stopped", "vm paused",
]

# Phrases of resource lines.
RESOURCE_PHRASES = ["claim", "resource", "disk", "memory", "vcpu", "attempting claim"]

# Keywords counted when inspecting a log.
INSPECT_WORDS = ["error", "failed", "failure", "exception", "timeout", "no valid host"]

# Issue categories in order of priority, each with its keywords.
CATEGORY_KEYWORDS = [
    ("timeout_issues", ["timeout", "timed out", "connection timeout", "nova-conductor",
                        "messaging timeout", "rpc timeout"]),
    ("resource_shortage", ["resource", "memory", "disk", "cpu", "allocation", "insufficient",
                           "space left", "no space", "allocation failure", "memory allocation"]),
    ("network_issues", ["network", "connection", "timeout", "unreachable", "dns",
                        "nova-conductor", "messaging", "rpc"]),
    ("service_failure", ["service", "nova", "keystone", "glance", "neutron", "failed",
                         "failure", "exception", "error"]),
    ("authentication", ["auth", "authentication", "token", "credential", "permission",
                        "denied", "unauthorized"]),
    ("instance_issues", ["instance", "vm", "spawn", "launch", "terminate", "destroy",
                         "state", "update instance"]),
    ("database", ["database", "mysql", "postgresql", "connection", "query",
                  "operationalerror", "db"]),
    ("storage", ["storage", "volume", "cinder", "swift", "object", "block", "vif",
                 "plugging"]),
]
DEFAULT_CATEGORY = "general"
UNKNOWN_CATEGORY = "unknown"

# Timeline events, first match wins; patterns are matched on lower case.
EVENT_PATTERNS = [
    (r"instance.*spawned", "Instance Spawned"),
    (r"instance.*destroyed", "Instance Destroyed"),
    (r"vm.*started", "VM Started"),
    (r"vm.*stopped", "VM Stopped"),
    (r"attempting.*claim", "Resource Claim Attempt"),
    (r"claim.*successful", "Resource Claim Successful"),
    (r"no valid host", "No Valid Host Found"),
    (r"terminating.*instance", "Instance Termination Started"),
    (r"error.*connection", "Connection Error"),
    (r"timeout", "Timeout Occurred"),
    (r"nova-conductor.*timeout", "Nova-Conductor Timeout"),
    (r"connection.*nova-conductor.*timeout", "Nova-Conductor Connection Timeout"),
    (r"failed.*update.*instance.*state", "Instance State Update Failed"),
    (r"messaging.*timeout", "Messaging Timeout"),
    (r"rpc.*timeout", "RPC Timeout"),
    (r"connection.*timed.*out", "Connection Timed Out"),
    (r"update.*instance.*state.*failed", "Instance State Update Failed"),
]

# Counters of resource lines, matched without regard to case.
RESOURCE_COUNTERS = [
    ("memory_issues", r"memory|ram"),
    ("disk_issues", r"disk|storage|space"),
    ("cpu_issues", r"cpu|processor"),
    ("allocation_failures", r"allocation|claim"),
]

# Counters of network lines, matched without regard to case.
NETWORK_COUNTERS = [
    ("connection_failures", r"connection|connect"),
    ("timeout_issues", r"timeout|timed out"),
    ("nova_conductor_timeouts", r"nova-conductor.*timeout"),
    ("messaging_timeouts", r"messaging.*timeout|rpc.*timeout"),
    ("instance_state_update_failures",
     r"failed.*update.*instance.*state|update.*instance.*state.*failed"),
    ("dns_issues", r"dns|hostname"),
    ("network_unreachable", r"unreachable|network"),
]

# Categories whose reports carry the resource or the network counters.
RESOURCE_COUNTER_CATEGORIES = ["resource_shortage"]
NETWORK_COUNTER_CATEGORIES = ["network_issues", "timeout_issues", "service_failure"]

# Advice by category; the last entry serves every other category.
ADVICE = {
    "resource_shortage": [
        "Check available resources on compute nodes",
        "Monitor resource usage patterns",
        "Consider scaling compute resources",
        "Review resource allocation policies",
    ],
    "network_issues": [
        "Verify network connectivity between services",
        "Check DNS resolution",
        "Monitor network timeouts",
        "Review network configuration",
    ],
    "timeout_issues": [
        "Check nova-conductor service status and connectivity",
        "Verify messaging/RPC timeout configurations",
        "Monitor system load and resource usage",
        "Review network latency between compute and conductor nodes",
        "Check for database connection issues affecting conductor",
        "Consider increasing timeout values if appropriate",
        "Verify message queue (RabbitMQ/ZeroMQ) health",
    ],
    "service_failure": [
        "Check service status and restart if necessary",
        "Verify service dependencies and connectivity",
        "Review service logs for additional errors",
        "Monitor system resources for service constraints",
    ],
    "authentication": [
        "Verify authentication tokens",
        "Check user permissions",
        "Review authentication policies",
        "Monitor authentication failures",
    ],
    "": [
        "Review system logs for additional context",
        "Check service health status",
        "Monitor system performance metrics",
        "Consider system maintenance if needed",
    ],
}

# Advice of an analysis that found nothing.
FAILED_ADVICE = [
    "Check system logs manually",
    "Verify service status",
    "Contact system administrator",
]

# Words that sort a recommendation by urgency; anything else is long term.
IMMEDIATE_WORDS = ["immediate", "urgent", "now", "asap"]
SHORT_TERM_WORDS = ["short", "quick", "temporary"]

# Engineered columns chosen as model input.
MODEL_COLUMNS = [
    "message_length", "word_count", "number_count", "uppercase_count",
    "hour", "day_of_week", "is_weekend", "is_business_hours",
    "time_since_prev", "logs_in_last_minute",
    "has_error", "has_failed", "has_exception", "has_timeout",
    "mentions_instance", "mentions_server", "mentions_network",
    "level_changed", "escalated_to_error", "error_rate_last_5",
    "is_long_message", "is_time_gap", "is_high_frequency", "is_error_burst",
    "errors_in_context_5", "services_in_context_5",
]

# Name parts that assign a column to a family of features.
COLUMN_FAMILIES = [
    ("temporal", ["hour", "day", "time", "minute"]),
    ("text", ["message", "word", "char", "length"]),
    ("instance", ["instance"]),
    ("error", ["error", "failed", "exception"]),
    ("context", ["context"]),
    ("anomaly", ["anomaly", "burst", "gap", "zscore"]),
]

# English function words left out of tokens.
STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
]

# Limits and weights.
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
MAX_TEXT_LENGTH = 1000
TOP_RELEVANT = 50
TOP_HITS = 20
HISTORY_SIZE = 10
HISTORY_CHARS = 2000
IMPORTANCE_PERCENTILE = 0.3
TFIDF_THRESHOLD = 0.1
WEIGHT_IMPORTANCE = 0.7
WEIGHT_SIMILARITY = 0.3
HIGH_SCORE = 0.8
VOCABULARY_SIZE = 500
SNAPSHOT_MAX_AGE_HOURS = 24
