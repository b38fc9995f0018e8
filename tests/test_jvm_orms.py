"""JPA entities and Exposed tables."""

import pytest
from building import build

from tessera.parsers import jvm_orms, parse_file

JAVA = """
import jakarta.persistence.*;

/** People who sign in. */
@Entity
@Table(name = "\\"accounts\\"", schema = "auth",
       indexes = { @Index(name = "ix", columnList = "code, created_at desc", unique = true) },
       uniqueConstraints = @UniqueConstraint(columnNames = {"a", "b"}))
public class Account extends Base<Long> implements Serializable {
    @Id
    @GeneratedValue(strategy = GenerationType.IDENTITY)
    private Long id;
    @Column(name = "email_address", nullable = false, unique = true, length = 255)
    private String email;
    private int loginCount = 0;
    private String bio;
    @Transient
    private String cache;
    static final String TABLE = "x";
    @Enumerated(EnumType.STRING)
    private Status status;
    @ManyToOne(optional = false)
    @JoinColumns({ @JoinColumn(name = "org_id", referencedColumnName = "id"), @JoinColumn(name = "org_tenant") })
    private Org org;
    @ManyToOne
    private Account boss;
    @OneToMany(mappedBy = "author")
    private java.util.List<Post> posts = new ArrayList<>();
    @ManyToMany
    @JoinTable(name = "account_roles")
    private Set<Role> roles;
    @Embedded
    private Address address;

    public Account() { this.bio = ""; }
    public String getBio() { return bio; }
    @Column(name = "nick_name") public String getNick() { return null; }
}

enum Status { NEW, PAID("x"); Status() {} }

@Embeddable record Address(String street, @Column(name = "town") String city) {}

@MappedSuperclass
abstract class Base<T> { @Column(nullable = false) private java.time.Instant createdAt; }
"""

KOTLIN = """
import jakarta.persistence.*

@Entity
@Table(name = "members")
class Member(
    @Id @GeneratedValue val id: Long? = null,
    @Column(name = "full_name") val fullName: String,
    val nickname: String?,
    @ManyToMany @JoinTable(name = "member_tags") val tags: MutableList<Tag> = mutableListOf(),
) : Person() {
    var age: Int = 0
    fun older() = age + 1
}

@Entity
class Tag(@Id val id: Long)
"""

EXPOSED = """
import org.jetbrains.exposed.dao.id.IntIdTable

enum class Kind { A, B }

object Cities : IntIdTable("cities") {
    val name = varchar("name", 50).uniqueIndex()
}

object UsersTable : LongIdTable() {
    val bio = text("bio").nullable()
    val score = decimal("score", 10, 2).default(0)
    val kind = enumerationByName("kind", 10, Kind::class)
    val city = reference("city_id", Cities, onDelete = ReferenceOption.CASCADE)
    val boss = optReference("boss_id", UsersTable)
    val since = long("since")
    init {
        index(false, city)
        uniqueIndex(city, since)
    }
}

object Films : Table() {
    val sequel = integer("sequel_id").references(Cities.id)
    override val primaryKey = PrimaryKey(sequel, name = "pk")
}

class User(id: EntityID<Int>) : IntEntity(id) {
    companion object : IntEntityClass<User>(UsersTable)
    var bio by UsersTable.bio
}
"""


def names(e):
    return [c.name for c in e.columns]


def test_java():
    (p,) = [x for x in parse_file("Account.java", JAVA) if x.kind == "jpa"]
    account, base = p.entities
    assert (account.name, account.schema, account.model_name, account.extends, account.comment, base.abstract) == ("accounts", "auth", "Account", ["Base"], "People who sign in.", True)
    assert names(account) == ["id", "email_address", "login_count", "bio", "status", "org_id", "org_tenant", "boss_id", "street", "town", "nick_name"]
    of = {c.name: c for c in account.columns}
    assert of["id"].generated and of["id"].primary_key and not of["email_address"].nullable and of["email_address"].unique and not of["login_count"].nullable and of["bio"].nullable
    assert of["status"].enum_ref == "Status" and p.enums[0].values == ["NEW", "PAID"] and not of["org_id"].nullable and of["boss_id"].nullable
    assert [(i.columns, i.unique) for i in account.indexes] == [(["code", "created_at"], True), (["a", "b"], True)]
    assert [(r.to.model, r.from_columns, r.cardinality, r.through and r.through.name) for r in p.relations] == [
        ("Org", ["org_id", "org_tenant"], "many-to-one", None),
        ("Account", ["boss_id"], "many-to-one", None),
        ("Role", [], "many-to-many", "account_roles"),
    ]
    assert names(base) == ["created_at"]


def test_inheritance():
    shared = jvm_orms.jpa("P.java", '@Entity @Table(name="payments") @Inheritance(strategy = InheritanceType.SINGLE_TABLE) class Payment { @Id Long id; }')
    child = jvm_orms.jpa("C.java", '@Entity @DiscriminatorValue("C") class Card extends Payment { String last4; }')
    assert {e["id"] for e in build([shared, child])["entities"]} == {"payments"}
    joined = jvm_orms.jpa("V.java", "@Entity @Inheritance(strategy = InheritanceType.JOINED) class Vehicle { @Id Long id; }\n@Entity class Car extends Vehicle { String doors; }")
    assert not joined.entities[1].shared_table and joined.entities[1].extends == ["Vehicle"]
    assert jvm_orms.jpa("A.java", '@Entity(name = "Account") class AccountEntity { @Id Long id; }').entities[0].name == "account"


def test_kotlin():
    p = jvm_orms.jpa("Member.kt", KOTLIN)
    member, tag = p.entities
    assert (member.name, member.extends, names(member), names(tag)) == ("members", ["Person"], ["id", "full_name", "nickname", "age"], ["id"])
    assert [c.nullable for c in member.columns] == [False, False, True, False]
    assert [(r.to.model, r.through.name) for r in p.relations] == [("Tag", "member_tags")]


def test_exposed():
    (p,) = [x for x in parse_file("Tables.kt", EXPOSED) if x.kind == "exposed"]
    cities, users, films = p.entities
    assert [(e.name, e.model_name, e.name_certainty) for e in p.entities] == [("cities", "Cities", 2), ("Users", "UsersTable", 0), ("Films", "Films", 0)]
    assert names(cities) == ["id", "name"] and cities.columns[1].type == "varchar(50)" and cities.columns[1].unique
    assert names(users) == ["id", "bio", "score", "kind", "city_id", "boss_id", "since"]
    of = {c.name: c for c in users.columns}
    assert (of["id"].type, of["bio"].nullable, of["score"].type, of["score"].default, of["kind"].enum_ref, of["boss_id"].nullable) == ("long", True, "decimal(10, 2)", "0", "Kind", True)
    assert [(i.columns, i.unique) for i in users.indexes] == [(["city_id"], False), (["city_id", "since"], True)]
    assert films.columns[0].primary_key and p.enums[0].values == ["A", "B"]
    assert [(r.from_.model, r.to.model, r.from_columns, r.on_delete, r.optional) for r in p.relations] == [
        ("UsersTable", "Cities", ["city_id"], "CASCADE", False),
        ("UsersTable", "UsersTable", ["boss_id"], None, True),
        ("Films", "Cities", ["sequel_id"], None, False),
    ]
    assert {("users", "cities"), ("users", "users"), ("films", "cities")} == {(r["from"], r["to"]) for r in build([p])["relations"]}


def test_comments_hide_entities():
    assert not jvm_orms.jpa("X.java", "// @Entity class Ghost { @Id Long id; }\nclass Plain {}").entities


@pytest.mark.parametrize("text", [JAVA, KOTLIN, EXPOSED, "@Entity class { }", "class User { @ManyToOne private", "@Entity\n@Table(\nclass User {", "object X : IntIdTable(", "@"])
def test_half_typed_files(text):
    for n in range(0, len(text) + 1, 13):
        for r in jvm_orms.READERS.values():
            r.parse("X.kt", text[:n])
            r.parse("X.java", text[:n])
    for r in jvm_orms.READERS.values():
        shape = lambda t: [(e.name, names(e), e.source.line) for e in r.parse("X.kt", t).entities]
        assert shape(text) == shape(text.replace("\n", "\r\n"))
