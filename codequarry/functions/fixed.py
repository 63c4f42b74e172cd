"""Names, word lists, patterns and dictionaries that define what the jobs compute."""

from __future__ import annotations

# --- fixed values: sources -------------------------------------------------------------------
SOURCE_EXTENSIONS = ("go", "proto")
EXCLUDED_DIRS = (
    ".git", ".build", "node_modules", "vendor", "dist", "build", ".idea", ".vscode", "__pycache__",
    ".cache", "DerivedData", "Pods", "target",
)
COMPOSE_NAMES = ("docker-compose.yml", "docker-compose.yaml", "compose.yml", "compose.yaml")
MANIFEST_NAMES = (*COMPOSE_NAMES, "go.mod", "Makefile")

# --- fixed values: services ------------------------------------------------------------------
SERVICE_MARKERS = (
    "Dockerfile", "go.mod", "main.go", "package.json", "requirements.txt", "setup.py",
    "pyproject.toml", "pom.xml", "build.gradle", "build.gradle.kts", "Cargo.toml", "composer.json",
    "Gemfile", "mix.exs", "CMakeLists.txt", "Makefile", "Program.cs",
)
SERVICE_MARKER_SUFFIX = ".csproj"
CONTAINER_DIRS = (
    "src", "services", "service", "apps", "microservices", "svc", "cmd", "modules", "components",
    "backend", "packages", "projects", "server", "servers",
)
REPO_DIR_MARKERS = (".git", "go.mod", "Dockerfile", "Makefile", "docker-compose.yml")
LANGUAGES = {
    "py": "Python", "java": "Java", "kt": "Kotlin", "scala": "Scala", "php": "PHP", "rb": "Ruby",
    "rs": "Rust", "cs": "C#", "ts": "TypeScript", "js": "JavaScript", "c": "C", "cpp": "C++",
    "cc": "C++", "h": "C/C++ Header", "hpp": "C++", "ex": "Elixir", "exs": "Elixir",
    "swift": "Swift", "dart": "Dart",
}

# --- fixed values: patterns of the extraction jobs (RE2 form) ----------------------------------
GO_IMPORT_SINGLE = r'^\s*import\s+"([^"]+)"'
GO_IMPORT_QUOTED = r'^\s*"([^"]+)"'
GO_TYPE = r"^type\s+(\w+)\s+(struct|interface)\b"
GO_FUNC = r"^func\s+(?:\(\s*\w+\s+\*?\w+\s*\)\s+)?(\w+)\s*\("
GO_COMMENT = r"^//\s?(.*)"
PROTO_IMPORT = r'^\s*import\s+"([^"]+)"'
PROTO_PACKAGE = r"^\s*package\s+(\S+)\s*;"
PROTO_KINDS = {
    "message": r"^\s*message\s+(\w+)",
    "service": r"^\s*service\s+(\w+)",
    "rpc": r"^\s*rpc\s+(\w+)",
    "enum": r"^\s*enum\s+(\w+)",
}
BIG_FUNCTION_LINES = 25

# --- fixed values: history -------------------------------------------------------------------
SEMVER = r"^v?\d+\.\d+\.\d+"
CONVENTIONAL = r"^(feat|fix|chore|refactor|docs|style|test|perf|ci|build|revert)(\(.+\))?!?:"
TICKET = r"(#\d+|[A-Z]+-\d+|GH-\d+)"
MAIN_NAMES = ("main", "master")
NEVER_STALE = ("main", "master", "develop", "HEAD")
WEEKDAYS = ("Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday")

# --- fixed values: technologies by import prefix ------------------------------------------------
IMPORT_TECH = {
    "google.golang.org/grpc": "gRPC",
    "google.golang.org/protobuf": "Protocol Buffers",
    "github.com/gin-gonic/gin": "Gin",
    "github.com/labstack/echo": "Echo",
    "github.com/gofiber/fiber": "Fiber",
    "github.com/gorilla/mux": "Gorilla Mux",
    "github.com/go-chi/chi": "Chi",
    "gorm.io/gorm": "GORM",
    "gorm.io/driver/postgres": "PostgreSQL",
    "github.com/jmoiron/sqlx": "sqlx",
    "github.com/jackc/pgx": "PostgreSQL",
    "github.com/lib/pq": "PostgreSQL",
    "github.com/go-redis/redis": "Redis",
    "github.com/redis/go-redis": "Redis",
    "go.mongodb.org/mongo-driver": "MongoDB",
    "github.com/segmentio/kafka-go": "Kafka",
    "github.com/IBM/sarama": "Kafka",
    "github.com/nats-io/nats.go": "NATS",
    "github.com/streadway/amqp": "RabbitMQ",
    "github.com/rabbitmq/amqp091-go": "RabbitMQ",
    "go.uber.org/zap": "Zap Logger",
    "github.com/sirupsen/logrus": "Logrus",
    "log/slog": "slog",
    "go.opentelemetry.io/otel": "OpenTelemetry",
    "github.com/prometheus/client_golang": "Prometheus",
    "github.com/elastic/go-elasticsearch": "Elasticsearch",
    "github.com/ClickHouse/clickhouse-go": "ClickHouse",
    "github.com/minio/minio-go": "MinIO",
    "github.com/aws/aws-sdk-go": "AWS SDK",
    "github.com/aws/aws-sdk-go-v2": "AWS SDK",
    "cloud.google.com/go": "Google Cloud",
    "k8s.io/client-go": "Kubernetes Client",
    "github.com/hashicorp/consul": "Consul",
    "github.com/hashicorp/vault": "HashiCorp Vault",
    "go.etcd.io/etcd": "etcd",
    "github.com/golang-jwt/jwt": "JWT",
    "github.com/spf13/cobra": "Cobra CLI",
    "github.com/spf13/viper": "Viper Config",
    "github.com/grpc-ecosystem/grpc-gateway": "gRPC Gateway",
    "github.com/99designs/gqlgen": "gqlgen (GraphQL)",
    "github.com/golang-migrate/migrate": "DB Migrations",
    "github.com/pressly/goose": "Goose Migrations",
    "github.com/swaggo/swag": "Swagger",
    "github.com/stretchr/testify": "Testify",
}

# --- fixed values: technologies by go.mod line prefix -------------------------------------------
# the import list without log/slog and with two more module paths
GOMOD_TECH = {k: v for k, v in IMPORT_TECH.items() if k != "log/slog"} | {
    "github.com/Shopify/sarama": "Kafka",
    "github.com/docker/docker": "Docker SDK",
}

# --- fixed values: technologies by Makefile keyword ---------------------------------------------
MAKEFILE_TECH = {
    "protoc": "Protocol Buffers", "grpc": "gRPC", "postgres": "PostgreSQL", "psql": "PostgreSQL",
    "redis-cli": "Redis", "mongo": "MongoDB", "kafka": "Kafka", "rabbitmq": "RabbitMQ",
    "nats": "NATS", "docker": "Docker", "kubectl": "Kubernetes", "helm": "Helm",
    "swagger": "Swagger", "migrate": "DB Migrations",
}

# --- fixed values: technologies by container image ----------------------------------------------
IMAGE_TECH = {
    "postgres": "PostgreSQL", "postgresql": "PostgreSQL", "mysql": "MySQL", "mariadb": "MariaDB",
    "mongo": "MongoDB", "redis": "Redis", "memcached": "Memcached", "rabbitmq": "RabbitMQ",
    "kafka": "Kafka", "zookeeper": "Zookeeper", "elasticsearch": "Elasticsearch",
    "opensearch": "OpenSearch", "kibana": "Kibana", "grafana": "Grafana",
    "prometheus": "Prometheus", "jaeger": "Jaeger", "nginx": "NGINX", "envoy": "Envoy",
    "consul": "Consul", "vault": "HashiCorp Vault", "nats": "NATS", "etcd": "etcd",
    "minio": "MinIO", "clickhouse": "ClickHouse", "influxdb": "InfluxDB", "temporal": "Temporal",
    "keycloak": "Keycloak", "traefik": "Traefik", "caddy": "Caddy", "localstack": "LocalStack",
    "cassandra": "Cassandra",
}

# --- fixed values: compose hints (words looked up in upper case, ports as written) ---------------
COMPOSE_HINTS = {
    "PostgreSQL": (("POSTGRES", "PGHOST"), "5432"),
    "Redis": (("REDIS",), "6379"),
    "MongoDB": (("MONGO",), "27017"),
    "Kafka": (("KAFKA",), "9092"),
    "RabbitMQ": (("RABBIT",), "5672"),
}

# --- fixed values: components in report order (technology, component, summary) -------------------
COMPONENTS = (
    ("Gin", "Gin", "Gin HTTP server"),
    ("Echo", "Echo", "Echo HTTP server"),
    ("Fiber", "Fiber", "Fiber HTTP server"),
    ("Chi", "Chi", "Chi router"),
    ("Gorilla Mux", "Gorilla Mux", "Gorilla Mux router"),
    ("gRPC", "gRPC", "gRPC"),
    ("gRPC Gateway", "gRPC Gateway", "gRPC Gateway"),
    ("gqlgen (GraphQL)", "GraphQL", "gqlgen GraphQL"),
    ("Swagger", "Swagger", "Swagger API docs"),
    ("GORM", "GORM", "GORM ORM"),
    ("sqlx", "sqlx", "sqlx"),
    ("DB Migrations", "Migrations", "DB Migrations"),
    ("Goose Migrations", "Goose", "Goose Migrations"),
    ("Kafka", "Kafka", "Kafka producer/consumer"),
    ("RabbitMQ", "RabbitMQ", "RabbitMQ messaging"),
    ("NATS", "NATS", "NATS messaging"),
    ("Redis", "Redis", "Redis client"),
    ("PostgreSQL", "PostgreSQL", "PostgreSQL"),
    ("MongoDB", "MongoDB", "MongoDB"),
    ("Elasticsearch", "Elasticsearch", "Elasticsearch"),
    ("ClickHouse", "ClickHouse", "ClickHouse"),
    ("MinIO", "MinIO", "MinIO object storage"),
    ("JWT", "JWT", "JWT authentication"),
    ("OpenTelemetry", "OpenTelemetry", "OpenTelemetry"),
    ("Prometheus", "Prometheus", "Prometheus metrics"),
    ("Cobra CLI", "Cobra", "Cobra CLI"),
    ("Viper Config", "Viper", "Viper Config"),
    ("AWS SDK", "AWS SDK", "AWS SDK"),
    ("Google Cloud", "Google Cloud", "Google Cloud"),
    ("Kubernetes Client", "Kubernetes", "Kubernetes Client"),
    ("Consul", "Consul", "Consul"),
    ("HashiCorp Vault", "Vault", "HashiCorp Vault"),
    ("etcd", "etcd", "etcd"),
    ("Testify", "Testify", "Testify"),
)

# --- fixed values: layers: name, directory names, file names ------------------------------------
LAYER_TESTS, LAYER_API, LAYER_OTHER = "Tests", "API / Routes", "Other"
LAYER_DISPLAY_ORDER = (
    "API / Routes", "Models / Schemas", "Services / Domain", "Persistence / DB", "Auth / Security",
    "Background Tasks", "Config / Settings", "CLI / Entry", "Infrastructure / Utils", "Tests", "Other",
)
TEST_DIRS = ("test", "tests", "testdata")
LAYER_RULES = (  # in matching order, after tests and proto files
    ("CLI / Entry",
     ("cmd", "cli", "command", "commands"),
     ("main.go", "cli.go", "cmd.go")),
    ("Config / Settings",
     ("config", "conf", "configuration", "settings", "constants"),
     ("config.go", "settings.go", "constants.go", "conf.go")),
    ("Auth / Security",
     ("auth", "authentication", "authorization", "security", "jwt"),
     ("auth.go", "jwt.go", "security.go", "oauth.go")),
    ("API / Routes",
     ("handler", "handlers", "controller", "controllers", "api", "apis", "route", "routes",
      "router", "endpoint", "endpoints", "http", "rest", "transport"),
     ("handler.go", "handlers.go", "router.go", "routes.go", "controller.go", "controllers.go",
      "endpoint.go", "endpoints.go")),
    ("Models / Schemas",
     ("model", "models", "entity", "entities", "domain", "schema", "schemas", "dto", "dtos"),
     ("model.go", "models.go", "entity.go", "schema.go", "dto.go", "types.go")),
    ("Services / Domain",
     ("service", "services", "usecase", "usecases", "use_case", "use_cases", "business", "core",
      "logic", "app"),
     ("service.go", "services.go", "usecase.go", "core.go")),
    ("Persistence / DB",
     ("repository", "repo", "repos", "storage", "db", "database", "dao", "migration", "migrations",
      "store"),
     ("repository.go", "repo.go", "storage.go", "db.go", "database.go", "dao.go", "migration.go")),
    ("Background Tasks",
     ("worker", "workers", "task", "tasks", "job", "jobs", "consumer", "consumers", "queue",
      "queues", "scheduler", "cron"),
     ("worker.go", "consumer.go", "scheduler.go", "cron.go", "job.go")),
    ("Infrastructure / Utils",
     ("util", "utils", "helper", "helpers", "common", "shared", "lib", "middleware",
      "infrastructure", "infra"),
     ("util.go", "utils.go", "helper.go", "helpers.go", "common.go", "errors.go", "error.go",
      "middleware.go")),
)

# --- fixed values: rule patterns (RE2 form) -----------------------------------------------------
SECRET = r'(?i)(password|passwd|secret|apikey|api_key|authkey)\s*[:=]+\s*"([^"]{8,})"'
SECRET_SKIP_WORDS = (
    "example", "test", "dummy", "fake", "sample", "placeholder", "your_", "xxx", "todo", "changeme",
)
SQL_CONCAT = r"\.(Query|Exec|QueryRow|QueryContext|ExecContext)\s*\([^)]*\+"
SQL_SPRINTF = r"\.(Query|Exec|QueryRow|QueryContext|ExecContext)\s*\(\s*fmt\.Sprintf"
PANIC_CALL = r"\bpanic\("
TYPE_ASSERT = r":=\s*\w[\w.()\[\]]*\.\(([A-Za-z*][\w.*]*)\)\s*(?:$|//)"
HTTP_CALL = r"\b(http\.(Get|Post|Put|Delete|Head)|\.Do\(|\.Get\(|\.Post\()"
BODY_CLOSE = r"defer.*\.Body\.Close\(\)"
FOR_LINE = r"\bfor\b.*\{"
FOR_RANGE = r"\bfor\b.+:=\s*range\b"
GO_FUNC_START = r"\bgo\s+func\b"
ASSIGN_WORDS = r"\w+\s*:=\s*\w+"
STRUCT_START = r"^type\s+(\w+)\s+struct\b"
MUTEX_FIELD = r"\bsync\.(RW)?Mutex\b"
IGNORED_ERROR = r"^\s*_\s*=\s*[\w.]+\("
ERROR_NOT_WRAPPED = r"errors\.New\(\w[\w.]*\.Error\(\)\)"
DEFER_LINE = r"^\s*defer\s"
DEFER_CLOSE = r"^\s*defer\s+\w[\w.]*\.(?:Close|Flush|Sync)\s*\(\s*\)\s*(?:$|//)"
ROWS_CLOSE = r"rows\.(?:Close|close)\(\)"
TIME_SLEEP = r"\btime\.Sleep\b"
CHANNEL_BUFFER = r"make\(\s*chan\b[^,)]+,\s*(\d+)"
NAKED_RETURN = r"^\s*return\s*(?://.*)?$"
MAKE_EMPTY_SLICE = r"make\(\s*\[\][\w\[\]*]+,\s*0\s*\)"
VAR_SLICE = r"^\s*var\s+(\w+)\s+\[\]"
APPEND_CALL = r"\bappend\("
PACKAGE_UNDERSCORE = r"^package\s+[a-z]+_[a-z]"
INIT_FUNC = r"^\s*func\s+init\s*\(\s*\)"
SPRINTF_INT = r'fmt\.Sprintf\s*\(\s*"%d"\s*,'
ERR_DECLARED = r",\s*err\s*:=|^\s*err\s*:="
TEST_ERR_CHECK = r"err\s*!=\s*nil|require\.NoError|assert\.NoError|t\.Fatal|t\.Error\s*\(\s*err"
