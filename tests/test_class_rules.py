import pytest

from plinth.operators import class_rules as C

NODE = "node_id long, parent_id long, kind string, role string, s long, target boolean, modifiers array<string>, explicit boolean, symbol string, scope long"
OWNER = "owner_id long, kind string, modifiers array<string>, explicit boolean, container string, name string, form string, types array<string>"
PARAMETER = "parameter_id long, owner_id long, position int, has_default boolean, is_params boolean, is_this boolean"


def pairs(df):
    return {tuple(r) for r in df.collect()}


def tree(spark, rows):
    """Rows (id, parent, kind, role, target[, modifiers[, symbol, scope]]); a node stands at its id in the text."""
    full = [(i, up, kind, role, i, target, list(more[0]) if more and more[0] is not None else None, None, *(more[1:] or (None, None))) for i, up, kind, role, target, *more in rows]
    return spark.createDataFrame(full, NODE)


def test_marks_of_a_class(spark):
    nodes = tree(spark, [
        (1, None, "ClassDeclaration", "member", True), (2, None, "FieldDeclaration", "member", False), (3, 2, "VariableDeclaration", "declaration", None),
        (4, 3, "GenericName", "type", False), (5, 4, "TypeArgumentList", "arguments", False), (6, 5, "IdentifierName", "argument", True),
        (7, None, "VariableDeclaration", "declaration", False), (8, 7, "GenericName", "type", True), (9, 8, "TypeArgumentList", "arguments", False), (10, 9, "IdentifierName", "argument", True),
        (11, None, "InvocationExpression", "expression", True), (12, 11, "SimpleMemberAccessExpression", "expression", True), (13, 12, "IdentifierName", "expression", True),
        (14, None, "CastExpression", "expression", True), (15, 14, "ObjectCreationExpression", "expression", True), (16, 15, "IdentifierName", "type", True),
    ])
    assert pairs(C.class_marks(nodes)) == {(1, C.DECLARATION_MARK), (6, C.TYPE_MARK), (11, C.EXPRESSION_MARK), (15, C.EXPRESSION_MARK)}
    assert pairs(C.type_marks(nodes)) == {(6, 3, "VariableDeclaration", True)}
    assert C.class_marks(nodes.limit(0)).count() == 0


def test_creations_and_later_names(spark):
    nodes = tree(spark, [
        (1, None, "IdentifierName", "expression", False, None, "x", 9), (2, None, "VariableDeclarator", "declarator", False, None, "x", 9), (3, 2, "EqualsValueClause", "initializer", False),
        (4, 3, "SimpleLambdaExpression", "value", False), (5, 4, "EqualsValueClause", "default", False), (6, 5, "ObjectCreationExpression", "value", True),
        (7, None, "IdentifierName", "expression", False, None, "x", 9), (8, None, "IdentifierName", "expression", False, None, "x", 8), (10, None, "IdentifierName", "expression", False, None, None, None),
        (11, None, "IdentifierName", "expression", False, None, "x", 9),
    ])
    marked = spark.createDataFrame([(6,), (11,)], "node_id long")
    declared = C.creation_declarators(marked, nodes)
    assert pairs(declared) == {(2, C.NEW_RULE, 6)}
    assert pairs(C.later_references(declared, marked, nodes)) == {(7, C.LOCAL_RULE, 2)}


def test_hosts_of_types(spark):
    rows, want, i = [], set(), 0
    cases = [  # host kind, its parent, owner kind, modifiers of the host, words of the parameter, expected
        ("FieldDeclaration", "ClassDeclaration", "VariableDeclaration", (), "Field"), ("EventFieldDeclaration", "InterfaceDeclaration", "VariableDeclaration", (), "InterfaceEvent"),
        ("EventFieldDeclaration", "ClassDeclaration", "VariableDeclaration", (), None), ("LocalDeclarationStatement", "Block", "VariableDeclaration", (), None),
        ("PropertyDeclaration", "InterfaceDeclaration", None, (), "InterfaceProperty"), ("PropertyDeclaration", "ClassDeclaration", None, None, "Property"),
        ("MethodDeclaration", "ClassDeclaration", None, ("private",), "PrivateReturn"), ("MethodDeclaration", "ClassDeclaration", None, ("public",), "PublicReturn"),
        ("MethodDeclaration", "ClassDeclaration", None, ("public", "virtual"), None), ("MethodDeclaration", "InterfaceDeclaration", None, (), "InterfaceMethod"),
        ("IndexerDeclaration", "InterfaceDeclaration", None, (), "InterfaceIndexer"), ("DelegateDeclaration", "ClassDeclaration", None, (), "DelegateReturn"),
    ]
    for host, over, owner, words, kind in cases:
        i += 10
        rows += [(i, None, over, "member", False), (i + 1, i, host, "member", False, words)]
        if owner:
            rows.append((i + 2, i + 1, owner, "declaration", False))
        part = "return" if host in ("MethodDeclaration", "DelegateDeclaration") else "type"
        rows.append((i + 3, i + 2 if owner else i + 1, "IdentifierName", part, True))
        if kind:
            want.add((i + 1, kind, i + 3))
    rows += [(500, None, "BaseList", "bases", False), (501, 500, "SimpleBaseType", "base", False), (502, 501, "IdentifierName", "type", True)]
    rows += [(510, None, "BaseList", "bases", False), (511, 510, "SimpleBaseType", "base", False), (512, 511, "IdentifierName", "type", False), (513, 510, "SimpleBaseType", "base", False), (514, 513, "IdentifierName", "type", True)]
    rows += [(520, None, "MethodDeclaration", "member", False, ("public", "static")), (521, 520, "ParameterList", "parameters", False), (522, 521, "Parameter", "parameter", False, ("this",)), (523, 522, "IdentifierName", "type", True)]
    rows += [(524, 521, "Parameter", "parameter", False, ("this",)), (525, 524, "IdentifierName", "type", True)]
    rows += [(530, None, "LocalDeclarationStatement", "statement", False), (531, 530, "VariableDeclaration", "declaration", False), (532, 531, "GenericName", "type", False), (533, 532, "TypeArgumentList", "arguments", False), (534, 533, "IdentifierName", "argument", True)]
    want |= {(500, "Base", 502), (513, "Base", 514), (520, "ExtensionReceiver", 523), (530, "LocalGeneric", 534)}
    nodes = tree(spark, rows)
    hosts = C.declaration_hosts(C.type_marks(nodes), nodes)
    assert pairs(hosts) == want
    assert pairs(C.host_proposals(hosts)) == {(C.HOST_PROPOSALS[kind], "Delete", i) for i, kind, _ in want}


def shrink(spark, kind, words, shape, argument_lists, overloads=(), position=1):
    """Modes of a two-parameter owner whose calls have the given arguments (position, named)."""
    flags = {"has_default": False, "is_params": False, "is_this": False} | dict.fromkeys(shape, True)
    owners = spark.createDataFrame([(1, kind, list(words), False, "C", "m", "", ["int", "T"])] + [(10 + i, kind, [], False, "C", "m", "", list(t)) for i, t in enumerate(overloads)], OWNER)
    parameters = spark.createDataFrame([(100, 1, 0, False, False, "receiver" in shape), (101, 1, 1, *[flags[k] for k in ("has_default", "is_params", "is_this")])], PARAMETER)
    calls = spark.createDataFrame([(1000 + i, 1) for i in range(len(argument_lists))], "call_id long, owner_id long")
    arguments = spark.createDataFrame([(1000 + i, j, at, named) for i, one in enumerate(argument_lists) for j, (at, named) in enumerate(one)], "call_id long, ordinal int, position int, named boolean")
    marked = spark.createDataFrame([(100 + position, 7), (100 + position, 8)], "parameter_id long, source long")
    plans = C.shrink_plans(marked, owners, parameters, calls, arguments)
    return plans, C.shrink_proposals(plans, calls, arguments)


PLAIN, NAMED, SHORT = [(0, False), (1, False)], [(1, True), (0, True)], [(0, False)]


@pytest.mark.parametrize(("kind", "words", "shape", "lists", "overloads", "want"), [
    ("MethodDeclaration", ["private"], [], [PLAIN, PLAIN], [], {"PrivatePositional"}), ("MethodDeclaration", ["private"], [], [], [], {"PrivatePositional"}),
    ("MethodDeclaration", ["private"], [], [PLAIN, NAMED], [], set()), ("MethodDeclaration", ["public"], [], [], [], set()), ("MethodDeclaration", ["public"], [], [PLAIN], [], {"PublicPositional"}),
    ("MethodDeclaration", ["public"], [], [NAMED, NAMED], [], {"NamedMethod"}), ("MethodDeclaration", ["public"], [], [NAMED], [["int"]], set()), ("MethodDeclaration", ["public"], [], [PLAIN], [["int"]], {"PublicPositional"}),
    ("MethodDeclaration", ["public"], ["has_default"], [SHORT, PLAIN], [], {"OptionalMethod"}), ("MethodDeclaration", ["private"], ["has_default"], [], [], {"OptionalMethod"}),
    ("MethodDeclaration", ["public"], ["is_params"], [SHORT], [], {"ParamsMethod"}), ("MethodDeclaration", ["public"], ["is_params"], [SHORT, PLAIN], [], set()),
    ("MethodDeclaration", ["public", "override"], [], [PLAIN], [], set()), ("MethodDeclaration", ["public", "static"], ["receiver"], [[(1, False)]], [], {"Extension"}),
    ("MethodDeclaration", ["public", "static"], ["receiver"], [PLAIN], [], {"Extension", "PublicPositional"}), ("LocalFunctionStatement", [], [], [PLAIN], [], {"LocalFunction"}),
    ("LocalFunctionStatement", [], [], [], [], set()), ("LocalFunctionStatement", [], [], [NAMED], [], {"NamedLocalFunction"}), ("LocalFunctionStatement", [], ["has_default"], [SHORT], [], {"OptionalLocalFunction"}),
    ("IndexerDeclaration", ["public"], [], [PLAIN], [], {"Indexer"}), ("IndexerDeclaration", ["public"], [], [NAMED], [], {"NamedIndexer"}),
])
def test_parameters_go_everywhere_or_nowhere(spark, kind, words, shape, lists, overloads, want):
    plans, units = shrink(spark, kind, words, shape, lists, overloads)
    assert {r.mode for r in plans.collect()} == want
    calls = {(1000 + i, j) for i, one in enumerate(lists) for j, (at, _) in enumerate(one) if at == 1}
    assert pairs(units) == {(C.SHRINK_PROPOSALS[m], "Replace", node, at, 7) for m in want for node, at in {(1, 1)} | calls}


def test_delegates(spark):
    kinds = {1: [("group", True)], 2: [("lambda", True), ("invocation", True)], 3: [("group", True), ("lambda", True)], 4: [("invocation", True)], 5: [], 6: [("group", False)], 7: [("type", True)]}
    owners = spark.createDataFrame([(i, "DelegateDeclaration", None, None, None, None, None, None) for i in kinds], OWNER)
    parameters = spark.createDataFrame([(100 + i, i, 0, False, False, None) for i in kinds], PARAMETER)
    uses = spark.createDataFrame([(i, use, 1000 + 10 * i + j, fits) for i, found in kinds.items() for j, (use, fits) in enumerate(found)], "owner_id long, use string, node_id long, fits boolean")
    plans = C.delegate_plans(spark.createDataFrame([(100 + i, i) for i in kinds], "parameter_id long, source long"), owners, parameters, uses)
    assert {(r.owner_id, r.mode) for r in plans.collect()} == {(1, "MethodGroup"), (2, "Lambda"), (4, "InvocationChain"), (5, "PlainDelegate")}
    none = spark.createDataFrame([], "call_id long, owner_id long"), spark.createDataFrame([], "call_id long, ordinal int, position int, named boolean")
    assert {(r.node_id, r.removed) for r in C.shrink_proposals(plans, *none, uses).collect()} == {(i, 0) for i in (1, 2, 4, 5, 1010, 1020, 1021, 1040)}
