"""The coder of ``coder.py`` in the JVM: the same payloads, byte by byte, some thirty times as fast.

An id costs a few dozen dependent steps, which array operations over many blocks do at some microseconds an id.
The class below is compiled by Janino, which Spark brings along for its own generated code, and goes to the executors as a jar.
"""

from __future__ import annotations

import tempfile
import zipfile

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SOURCE = """
package notelake.llm;

import java.nio.ByteBuffer;
import java.nio.ByteOrder;
import java.util.Arrays;
import org.apache.spark.sql.api.java.UDF2;
import org.apache.spark.sql.api.java.UDF3;

/** Ids (little-endian, 32 bits each) and their number of bits: the payload. */
public final class Encode implements UDF2 {
    public Object call(Object ids, Object bits) {
        byte[] given = (byte[]) ids;
        int[] read = new int[given.length / 4];
        ByteBuffer.wrap(given).order(ByteOrder.LITTLE_ENDIAN).asIntBuffer().get(read);
        return Coder.encode(read, ((Integer) bits).intValue());
    }
}

/** The payload, how many ids it has and their number of bits: the ids. */
public final class Decode implements UDF3 {
    public Object call(Object payload, Object n, Object bits) {
        int[] ids = Coder.decode((byte[]) payload, Math.toIntExact(((Long) n).longValue()), ((Integer) bits).intValue());
        ByteBuffer out = ByteBuffer.allocate(4 * ids.length).order(ByteOrder.LITTLE_ENDIAN);
        out.asIntBuffer().put(ids);
        return out.array();
    }
}

/** See coder.py for the model; a block at a time. */
final class Coder {
    private static final int SLOTS = 4096, NODES = 1024, TOTAL = 65536;
    private static final long BOTTOM = 1L << 40, MASK = (1L << 56) - 1;
    // Four frequencies of 16 bits are one number; times ONES, its digits are their running sums.
    private static final long ONES = 0x0001000100010001L, FLOOR = 64 * ONES, LOSS = 0x07FF * ONES, GAIN = 1984;

    /** A thread's tables, which stay in its core's cache from block to block. */
    private static final ThreadLocal OWN = new ThreadLocal();

    private final int[] followed = new int[2 * SLOTS];
    private final char[] seen = new char[SLOTS];
    private final long[] hits = new long[48];
    private final long[][] tree;
    private boolean given;
    private ByteBuffer data;
    private int size;
    private long low, span, value;

    private Coder(int levels) {
        this.tree = new long[levels][];
        for (int k = 0; k < levels; k++) {
            this.tree[k] = new long[4 * (k > 2 ? NODES : 1 << 4 * k)];
        }
    }

    private static Coder start(boolean given, byte[] data, int bits) {
        int levels = (bits + 3) / 4;
        Coder made = (Coder) OWN.get();
        if (made == null || made.tree.length != levels) {
            made = new Coder(levels);
            OWN.set(made);
        }
        Arrays.fill(made.followed, 0);
        Arrays.fill(made.seen, (char) 0);
        Arrays.fill(made.hits, (TOTAL - 2048) / 4 * ONES);
        for (int k = 0; k < levels; k++) {
            Arrays.fill(made.tree[k], (TOTAL - 2048) / 16 * ONES);
        }
        made.given = given;
        made.data = ByteBuffer.wrap(data);
        made.size = 0;
        made.low = made.value = 0;
        made.span = MASK;
        return made;
    }

    /** Moves out the upper bytes; the buffer always has room for eight more. */
    private void shift(int bytes) {
        int by = bytes << 3;
        if (this.given) {
            if (this.size + 16 > this.data.capacity()) {
                this.data = ByteBuffer.wrap(Arrays.copyOf(this.data.array(), 2 * this.data.capacity()));
            }
            this.data.putLong(this.size, this.low << 8);
        } else {
            long next = this.data.getLong(Math.min(this.size, this.data.capacity() - 8));
            this.value = this.value << by & MASK | next >>> 8 >>> 56 - by;
        }
        this.size += bytes;
        this.low = this.low << by & MASK;
        this.span <<= by;
    }

    /** How many upper bytes can no longer change. */
    private int equal() {
        return Math.max(Long.numberOfLeadingZeros(this.low ^ this.low + this.span), 8) - 8 >>> 3;
    }

    private void settle() {
        this.shift(this.equal());
        while (this.span < BOTTOM) {
            this.span = -this.low & BOTTOM - 1;
            this.shift(1);
            this.shift(this.equal());
        }
    }

    /** 1 where what is to be decoded lies at or above a cumulated frequency; broken payloads lie above all. */
    private static int above(long rest, long unit, int end) {
        return (int) (unit * end - 1 - rest >>> 63);
    }

    private long rest() {
        long rest = this.value - this.low;
        return rest < 0 ? 1L << 58 : rest;
    }

    private void narrow(long unit, int below, int end) {
        this.low += unit * below;
        this.span = unit * (end - below);
    }

    private int digit(long[] rows, int at, int digit) {
        long unit = this.span >>> 16;
        long row0 = rows[at], row1 = rows[at + 1], row2 = rows[at + 2], row3 = rows[at + 3];
        long ends0 = (row0 + FLOOR) * ONES, ends1 = (row1 + FLOOR) * ONES, ends2 = (row2 + FLOOR) * ONES;
        int end0 = (int) (ends0 >>> 48), end1 = end0 + (int) (ends1 >>> 48), end2 = end1 + (int) (ends2 >>> 48);
        long rest = this.given ? 0 : this.rest();
        int four = this.given ? digit >> 2 : above(rest, unit, end0) + above(rest, unit, end1) + above(rest, unit, end2);
        int base = (int) (((long) end0 << 16 | (long) end1 << 32 | (long) end2 << 48) >>> (four << 4) & 65535);
        long ends = (rows[at + four] + FLOOR) * ONES;
        if (!this.given) {
            rest -= unit * base;
            digit = four << 2;
            digit += above(rest, unit, (int) (ends & 65535)) + above(rest, unit, (int) (ends >>> 16 & 65535)) + above(rest, unit, (int) (ends >>> 32 & 65535));
        }
        int by = (digit & 3) << 4;
        this.narrow(unit, base + (int) (ends << 16 >>> by & 65535), digit == 15 ? TOTAL : base + (int) (ends >>> by & 65535));
        rows[at] = row0 - (row0 >>> 5 & LOSS);
        rows[at + 1] = row1 - (row1 >>> 5 & LOSS);
        rows[at + 2] = row2 - (row2 >>> 5 & LOSS);
        rows[at + 3] = row3 - (row3 >>> 5 & LOSS);
        rows[at + four] += GAIN << by;
        return digit;
    }

    private void run(int[] ids) {
        int levels = this.tree.length;
        int[] followed = this.followed;
        char[] seen = this.seen;
        long[] hits = this.hits;
        long w0 = 4096, w1 = 4096, w2 = 4096;
        int last = 0, before = 0, recent = 0, frequent = 0, best = 0;
        for (int t = 0; t < ids.length; t++) {
            int c0 = last * 0x9E5 + before * 0x3779 + (last >> 7) & SLOTS - 1, c1 = SLOTS + (last & SLOTS - 1);
            int k0 = followed[c0], k1 = followed[c1], g0 = k0 >> 4, g1 = k1 >> 4;
            int p0 = k0 & 15, p1 = 16 + (k1 & 15), p2 = 32 + recent;
            long h0 = hits[p0], h1 = hits[p1], h2 = hits[p2];
            double all = w0 + w1 + w2;
            int e0 = (int) (((h0 & 65535) * w0 + (h1 & 65535) * w1 + (h2 & 65535) * w2) / all) + 64;
            int e1 = e0 + (int) (((h0 >>> 16 & 65535) * w0 + (h1 >>> 16 & 65535) * w1 + (h2 >>> 16 & 65535) * w2) / all) + 64;
            int e2 = e1 + (int) (((h0 >>> 32 & 65535) * w0 + (h1 >>> 32 & 65535) * w1 + (h2 >>> 32 & 65535) * w2) / all) + 64;
            long unit = this.span >>> 16, ends = (long) e0 << 16 | (long) e1 << 32 | (long) e2 << 48;
            int hit, id = ids[t];
            if (this.given) {
                hit = id == g0 ? 0 : id == g1 ? 1 : id == frequent ? 2 : 3;
            } else {
                long rest = this.rest();
                hit = above(rest, unit, e0) + above(rest, unit, e1) + above(rest, unit, e2);
            }
            int by = hit << 4;
            this.narrow(unit, (int) (ends >>> by & 65535), hit == 3 ? TOTAL : (int) (ends >>> by + 16 & 65535));
            w0 += (h0 >>> by + 4 & 4095) + 16 - (w0 >> 4);
            w1 += (h1 >>> by + 4 & 4095) + 16 - (w1 >> 4);
            w2 += (h2 >>> by + 4 & 4095) + 16 - (w2 >> 4);
            hits[p0] = h0 - (h0 >>> 5 & LOSS) + (GAIN << by);
            hits[p1] = h1 - (h1 >>> 5 & LOSS) + (GAIN << by);
            hits[p2] = h2 - (h2 >>> 5 & LOSS) + (GAIN << by);
            if (hit == 3) {
                int prefix = 0;
                for (int k = 0; k < levels; k++) {
                    long[] rows = this.tree[k];
                    int node = (prefix << 2) & rows.length - 1;
                    prefix = prefix << 4 | this.digit(rows, node, id >> 4 * (levels - 1 - k) & 15);
                    if ((k & 1) == 0) {
                        this.settle();
                    }
                }
                id = prefix;
            } else {
                id = hit == 0 ? g0 : hit == 1 ? g1 : frequent;
            }
            this.settle();
            ids[t] = id;
            followed[c0] = id << 4 | (id == g0 ? Math.min((k0 & 15) + 1, 15) : 0);
            followed[c1] = id << 4 | (id == g1 ? Math.min((k1 & 15) + 1, 15) : 0);
            int count = ++seen[id & SLOTS - 1];
            if (count > best) {
                frequent = id;
                best = count;
            }
            recent = (recent << 2 | hit) & 15;
            before = last;
            last = id;
        }
    }

    static byte[] encode(int[] ids, int bits) {
        Coder made = start(true, new byte[2 * ids.length + 64], bits);
        made.run(ids);
        made.shift(7);
        return Arrays.copyOf(made.data.array(), made.size);
    }

    static int[] decode(byte[] payload, int n, int bits) {
        int[] ids = new int[n];
        Coder made = start(false, Arrays.copyOf(payload, payload.length + 16), bits);
        made.shift(7);
        made.span = MASK;
        made.run(ids);
        return ids;
    }
}
"""

_LOADED: dict[str, tuple[tempfile.TemporaryDirectory, JavaObject]] = {}


def _classes(spark: SparkSession) -> JavaObject:
    """The class loader of the compiled classes; executors get them once per application."""
    context, jvm = spark.sparkContext, spark._jvm
    if context.applicationId not in _LOADED:
        compiler = jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(SOURCE)
        folder = tempfile.TemporaryDirectory(prefix="notelake-")
        jar = f"{folder.name}/notelake-coder.jar"
        with zipfile.ZipFile(jar, "w") as out:
            for name, code in compiler.getBytecodes().items():
                out.writestr(name.replace(".", "/") + ".class", bytes(code))
        context._jsc.addJar(jar)
        _LOADED[context.applicationId] = folder, compiler.getClassLoader()
    return _LOADED[context.applicationId][1]


def _call(spark: SparkSession, kind: str, *columns: Column) -> Column:
    made = _classes(spark).loadClass(f"notelake.llm.{kind}").getConstructors()[0].newInstance(spark.sparkContext._gateway.new_array(spark._jvm.Object, 0))
    name = f"notelake_{kind.lower()}_block"
    spark._jsparkSession.udf().register(name, made, spark._jvm.org.apache.spark.sql.types.DataTypes.BinaryType)
    return F.call_function(name, *columns)


def encoded(spark: SparkSession, ids: Column, bits: Column) -> Column:
    """The payload of a block of ids, little-endian integers of 32 bits."""
    return _call(spark, "Encode", ids, bits)


def decoded(spark: SparkSession, payload: Column, n: Column, bits: Column) -> Column:
    """The ids of a payload, as ``encoded`` takes them."""
    return _call(spark, "Decode", payload, n, bits)
