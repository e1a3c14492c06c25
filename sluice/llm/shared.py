"""Objects that every task needs, sent once to each executor."""

from pyspark import cloudpickle


class Shared:
    """A broadcast object of any class of this package, which executors need not have installed.

    A broadcast names the classes of its objects, so what is sent are bytes that hold the classes, too.
    """

    def __init__(self, spark, thing):
        self.sent, self._thing = spark.sparkContext.broadcast(cloudpickle.dumps(thing)), None

    def __getstate__(self):
        return {"sent": self.sent, "_thing": None}

    @property
    def value(self):
        if self._thing is None:
            self._thing = cloudpickle.loads(self.sent.value)
        return self._thing
