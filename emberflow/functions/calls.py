"""Which effect a call of a well-known library performs, as rules: an owner or package, a pattern of the method and, where it
matters, the beginning of the descriptor. The longest owner wins."""

from __future__ import annotations

#: Owners by effect; after a # a method or a list of methods, each a pattern that must match whole.
RULES = {
    "Fs": """java.io.File#(create.*|delete.*|exists|is.*|last.*|length|list.*|mkdirs?|renameTo|set.*|can.*) java.io.FileInputStream java.io.FileOutputStream
        java.io.FileReader java.io.FileWriter java.io.RandomAccessFile java.nio.file.Files java.nio.file.FileSystem java.nio.channels.FileChannel
        java.util.zip.ZipFile java.util.jar.JarFile org.apache.commons.io.FileUtils org.apache.commons.io.file. com.google.common.io.Files
        okio.FileSystem kotlin.io.FilesKt scala.io.Source#fromFile org.apache.hadoop.fs.FileSystem""",
    "Net": """java.net.Socket java.net.ServerSocket java.net.DatagramSocket java.net.URLConnection java.net.HttpURLConnection java.net.URL#open(Connection|Stream)
        java.net.InetAddress#(getByName|getAllByName|isReachable|getLocalHost) java.net.URL#getContent@() java.net.URL#getContent@([Ljava/lang/Class;) java.net.http.HttpClient java.nio.channels.SocketChannel
        java.nio.channels.ServerSocketChannel java.nio.channels.DatagramChannel java.nio.channels.AsynchronousSocketChannel javax.net.
        org.apache.http. org.apache.hc.client5. okhttp3.Call okhttp3.OkHttpClient retrofit2.Call io.netty.bootstrap. io.netty.channel.socket. io.grpc.ManagedChannel
        io.grpc.stub. org.eclipse.jetty.client. org.springframework.web.client. org.springframework.web.reactive.function.client. javax.mail.Transport
        jakarta.mail.Transport com.rabbitmq.client. org.apache.kafka.clients. software.amazon.awssdk. com.amazonaws. com.google.cloud. com.azure.
        io.vertx.core.http. feign.Client javax.ws.rs.client. jakarta.ws.rs.client. java.rmi. javax.naming.""",
    "Db": """java.sql.Connection java.sql.Statement java.sql.PreparedStatement java.sql.CallableStatement java.sql.DriverManager java.sql.ResultSet#(next|update.*|insertRow|deleteRow)
        javax.sql.DataSource javax.persistence.EntityManager javax.persistence.Query jakarta.persistence.EntityManager jakarta.persistence.Query org.hibernate.Session
        org.springframework.jdbc. org.springframework.data. org.jooq.DSLContext org.apache.ibatis.session. org.jdbi. com.mongodb.client. redis.clients.jedis. io.lettuce.core.
        com.datastax. org.neo4j.driver. org.elasticsearch.client. org.apache.hadoop.hbase.client. io.r2dbc.""",
    "Exec": "java.lang.ProcessBuilder#start java.lang.Runtime#exec org.apache.commons.exec. org.zeroturnaround.exec. scala.sys.process.",
    "Env": "java.lang.System#(getenv|getProperty|getProperties|setProperty|clearProperty) java.util.prefs. org.apache.commons.lang3.SystemUtils io.github.cdimascio.dotenv.",
    "Clock": """java.lang.System#(currentTimeMillis|nanoTime) java.time.Instant#now java.time.LocalDate#now java.time.LocalDateTime#now java.time.LocalTime#now
        java.time.ZonedDateTime#now java.time.OffsetDateTime#now java.time.Clock#(instant|millis) java.lang.Thread#sleep org.joda.time.DateTime#now""",
    "Rand": "java.util.Random#(next.*|ints|longs|doubles) java.util.Collections#shuffle@(Ljava/util/List;)V java.security.SecureRandom java.util.UUID#randomUUID java.lang.Math#random java.util.concurrent.ThreadLocalRandom java.util.SplittableRandom org.apache.commons.lang3.RandomUtils",
    "Log": """java.util.logging. org.slf4j. org.apache.logging.log4j. org.apache.log4j. ch.qos.logback. org.apache.commons.logging. org.jboss.logging. io.github.oshai.kotlinlogging.
        java.lang.System.Logger com.google.common.flogger.""",
    "Ipc": "java.nio.channels.Pipe java.net.UnixDomainSocketAddress sun.misc.Signal com.sun.jna. java.lang.foreign. sun.nio.ch.Pipe",
    "Clipboard": "java.awt.datatransfer.Clipboard java.awt.Toolkit#getSystemClipboard javafx.scene.input.Clipboard",
    "Llm": "com.openai. com.theokanning.openai. dev.langchain4j.model. org.springframework.ai.chat. software.amazon.awssdk.services.bedrockruntime.",
    "Unknown": """java.lang.reflect.Method#invoke java.lang.reflect.Constructor#newInstance java.lang.Class#(forName|newInstance) java.lang.reflect.Proxy java.lang.invoke.MethodHandle#invoke.*
        java.lang.ClassLoader#(loadClass|defineClass) java.util.ServiceLoader#load javax.script. java.lang.System#(load|loadLibrary)""",
}


def rules() -> list[tuple[int, str, str, str, str | None]]:
    """(priority, owner, method_pattern, effect, descriptor), smaller priorities first: the longest owner, then rules with
    a descriptor, then those with a method. A list of methods is a rule for each; a descriptor stands after an @."""
    rows = []
    for effect, text in RULES.items():
        for word in text.split():
            owner, _, rest = word.partition("#")
            methods, _, begin = rest.partition("@")
            each = methods[1:-1].split("|") if methods.startswith("(") and methods.endswith(")") else [methods]
            rows += [(owner.rstrip("."), f"^({m})$" if m else ".*", effect, begin or None) for m in each]
    rows = list(dict.fromkeys(rows))
    rows.sort(key=lambda r: (-len(r[0]), r[3] is None, r[1] == ".*", r[0], r[1], r[2]))
    return [(i, *r) for i, r in enumerate(rows)]
