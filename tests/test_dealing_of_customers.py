import pytest

from maskflow.plans import catalog

NAMES = (
    *(f"spans_{k}" for k in ("invoice_no", "contract_no", "url", "iban", "bitcoin", "tron", "tax_id", "china_id")),
    *(f"mask_{k}" for k in ("crypto_address", "china_id", "credit_card")),
)


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    """25,000 customers in one file of one split."""
    folder = tmp_path_factory.mktemp("customers")
    spark.range(25_000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(folder / "customer.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_tasks_grow_with_the_customers(spark, customers, name):
    assert catalog.QUERIES[name](spark, customers).rdd.getNumPartitions() == 3
