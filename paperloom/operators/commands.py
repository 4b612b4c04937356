"""Commands: lists of them, checks of their arguments, and batches that stop at the first failure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.operators.text import catalog_search

#: Steps of a batch at most (fixed value).
STEPS = 1000


def command_list(commands: DataFrame, query: str = "", columns: tuple[str, ...] = ("id", "title"), enabled_only: bool = False) -> DataFrame:
    """Commands whose columns hold every word of the query, and that are enabled if that is asked for."""
    found = catalog_search(commands, query, list(columns)) if query.split() else commands
    return found.where("enabled") if enabled_only else found


def checked(steps: DataFrame, tools: DataFrame) -> DataFrame:
    """``steps`` (id, params: JSON text) with ``envelope`` and ``error``, both null where a step can run.

    ``tools`` has command, known and required (arrays of names).  An envelope is broken without an id or with params
    that are no object; else the command has to exist, take every argument given and get every one required.  The
    first unknown argument in the params' order counts, then the first missing one; a null argument is missing.  No
    params are an empty object.
    """
    params = F.coalesce("params", F.lit("{}"))
    given = F.when(F.btrim(params) == "null", F.array().cast("array<string>")).otherwise(F.json_object_keys(params))
    values = F.from_json(F.coalesce("params", F.lit("{}")), "map<string,string>")
    spec = tools.select(F.col("command").alias("__c"), F.col("known").alias("__known"), F.col("required").alias("__required"))
    met = steps.join(spec, F.col("id") == F.col("__c"), "left").withColumn("__given", given).withColumn("__there", F.coalesce(F.map_keys(F.map_filter(values, lambda k, v: v.isNotNull())), F.array().cast("array<string>")))
    unknown = F.get(F.array_except("__given", "__known"), F.lit(0))
    missing = F.get(F.array_except("__required", "__there"), F.lit(0))
    envelope = F.when(F.col("id").isNull(), "a step needs an id").when(F.col("__given").isNull(), "step params must be an object")
    error = (
        F.when(envelope.isNotNull(), envelope)
        .when(F.col("__c").isNull(), F.concat(F.lit("no command "), "id"))
        .when(unknown.isNotNull(), F.concat("id", F.lit(": unknown argument "), unknown))
        .when(missing.isNotNull(), F.concat("id", F.lit(": missing argument "), missing))
    )
    return met.select(*steps.columns, envelope.alias("envelope"), error.alias("error"))


def batch_results(steps: DataFrame, tools: DataFrame, stop_on_error: bool = True, most: int = STEPS) -> DataFrame:
    """(batch, step, id, ok, error) of the steps (batch, step, id, params) that run.

    No step of a batch runs if an envelope is broken or there are over ``most``.  A batch ends at its first failure,
    by step, unless it is told to go on.
    """
    told = checked(steps, tools)
    whole = told.groupBy("batch").agg(F.count("*").alias("__n"), F.count("envelope").alias("__broken"), F.min(F.when(F.col("error").isNotNull(), F.col("step"))).alias("__first"))
    run = told.join(whole, "batch").where((F.col("__n") <= most) & (F.col("__broken") == 0))
    if stop_on_error:
        run = run.where(F.col("__first").isNull() | (F.col("step") <= F.col("__first")))
    return run.select("batch", "step", "id", F.col("error").isNull().alias("ok"), "error")


def batch_summary(steps: DataFrame, tools: DataFrame, stop_on_error: bool = True, most: int = STEPS) -> DataFrame:
    """(batch, completed, failed, rejected) of every batch; a rejected one says why: its size, else its first broken envelope."""
    told = checked(steps, tools)
    broken = F.min(F.when(F.col("envelope").isNotNull(), F.struct("step", "envelope")))["envelope"]
    first = F.min(F.when(F.col("error").isNotNull(), F.col("step")))
    all_of = told.groupBy("batch").agg(F.count("*").alias("n"), broken.alias("broken"), first.alias("first"), F.count("error").alias("errors"))
    why = F.when(F.col("n") > most, F.format_string("a batch has at most %d steps (%d given)", F.lit(most), F.col("n"))).otherwise(F.col("broken"))
    if not stop_on_error:
        return all_of.select("batch", F.when(why.isNull(), F.col("n") - F.col("errors")).otherwise(0).alias("completed"), F.when(why.isNull(), F.col("errors")).otherwise(0).alias("failed"), why.alias("rejected"))
    before = told.join(all_of.select("batch", F.col("first").alias("__first")), "batch").groupBy("batch").agg(F.count_if(F.col("__first").isNull() | (F.col("step") < F.col("__first"))).alias("completed"))
    return all_of.join(before, "batch").select("batch", F.when(why.isNull(), F.col("completed")).otherwise(0).alias("completed"), F.when(why.isNull() & F.col("first").isNotNull(), 1).otherwise(0).cast("long").alias("failed"), why.alias("rejected"))
